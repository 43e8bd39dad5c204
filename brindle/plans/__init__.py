"""The typed query language: filter text to syntax tree to bound Column, ordering, projection and keyset paging."""

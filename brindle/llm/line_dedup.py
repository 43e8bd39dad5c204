"""Repeated and nearly repeated lines by a segment-partition edit join, in SQL operations throughout.

Lines are what stands between line feeds.  A line of at least ``min_chars`` characters goes when an equal line, or
one at most ``max_edits`` insertions, deletions and substitutions away, stands earlier in the corpus (smaller doc_id,
then earlier in its document); shorter lines always stay.  Lines are judged on the input, so a removed line still counts as earlier
for others.  What stays of a document keeps its order and line feeds.

Equal lines are found by their SHA-256, folded on the map side, so a line that stands in every document is one row
per partition.  For the rest, each distinct line is split into two segments, one more than the threshold: of two
lines an edit apart, one segment agrees, at the shift that their lengths give.  Segments are index rows keyed by
length, number and content; a line probes the keys of its own length and of the next smaller one.  A segment that
many lines share is not joined as it is: its lines also have to agree on all but a quarter, a sixteenth and so on of
the rest (``candidates``), which loses no pair and bounds every group by the alphabet.  Candidates are verified by a
bit-parallel edit distance on a band of 2 * max_edits + 1 diagonals held in one integer.

That is for one edit.  With more, each line is split into max_edits + 1 segments, of which one agrees with at most i
edits before segment i; a line probes its own and smaller lengths at the shifts that leaves (``far_candidates``).  The
lines of a hot segment also have to agree on a segment of the longest part that is left, ``ROUNDS`` times over; what is
hot then is joined as it is, so that no pair is lost, but lines that many near copies share can make many pairs.

Null text counts as empty: one empty line.  A null doc_id comes after all others.  Rows equal in doc_id and text
are one document and get the same result.  Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import read_table, row_key, stage, text_or_empty

HOT = 32
ROUNDS = 2
BROADCAST_LINES = 1_000_000
LAST = (1 << 63) - 1


def interval_key(line: Column, parts: int, e: Column, less: int | Column) -> Column:
    """The key of a line without its interval ``e`` of ``parts``, cut as a line ``less`` characters shorter is cut.

    Two lines of lengths n and n + less that agree before and after interval e of the shorter one have one key.
    """
    n = F.char_length(line)
    less = less if isinstance(less, Column) else F.lit(less)
    low, high = (F.floor((n - less).cast("long") * k / parts).cast("int") for k in (e, e + 1))
    return F.xxhash64(F.lit(parts), n - less, e, F.substr(line, F.lit(1), low), F.substr(line, high + less + 1))


def segment_keys(line: Column) -> tuple[Column, Column]:
    """Keys of the two halves of a line as an index entry, and of both at its own length and one less as a probe."""
    half = [F.lit(0), F.lit(1)]
    return F.array(*[interval_key(line, 2, e, 0) for e in half]), F.array(*[interval_key(line, 2, e, less) for e in half for less in (0, 1)])


def candidates(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of line ids (a < b) that agree outside of some interval.

    Keys that more than ``HOT`` index lines share are not joined: their lines, and only theirs, are asked again with
    the interval cut in four, down to single characters, where a key cannot have more lines than there are
    characters.  Lines that agree outside an interval agree outside one of its quarters, so no pair is lost.
    """
    index = distinct.select("lid", F.posexplode("index").alias("e", "key"), F.lit(0).alias("less"), F.lit(True).alias("held"))
    probe = distinct.select("lid", F.posexplode("probe").alias("p", "key")).select("lid", F.floor(F.col("p") / 2).cast("int").alias("e"), "key", F.pmod("p", F.lit(2)).alias("less"), F.lit(False).alias("held"))
    keys, parts, found, texts, n_lines = index.unionByName(probe), 2, [], None, distinct.count()
    while True:
        hot = stage(keys.filter("held").groupBy("key").count().filter(F.col("count") > HOT).select("key"), "line-hot", 2 * n_lines // HOT)
        n_hot = hot.count()
        few = n_hot <= BROADCAST_LINES
        again = n_hot > 0 and parts <= (distinct.agg(F.max("n")).first()[0] or 0)
        cold = keys.join(F.broadcast(hot) if few else hot, "key", "left_anti") if again else keys
        a, b = cold.filter("held").select("key", F.col("lid").alias("a")), cold.filter("NOT held").select("key", F.col("lid").alias("b"))
        found.append(stage(a.join(b, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs", n_lines))
        if not again:
            break
        warm = stage(keys.join(F.broadcast(hot) if few else hot, "key", "left_semi").select("lid", "e", "less", "held").distinct(), "line-warm", 6 * n_lines)
        if texts is None:
            texts = _texts(lines, warm.select("lid").distinct(), n_lines)
        parts *= 4
        cut = warm.join(texts, "lid").withColumn("e", F.explode(F.sequence(F.col("e") * 4, F.col("e") * 4 + 3)))
        keys = stage(cut.select("lid", "e", interval_key(F.col("line"), parts, F.col("e"), F.col("less")).alias("key"), "less", "held"), "line-keys", 24 * n_lines)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stage(out.distinct(), "line-candidates", n_lines) if len(found) > 1 else out


def far_keys(line: Column, max_edits: int) -> tuple[Column, Column]:
    """Keys of the segments of a line as an index entry, and as a probe of its own and of smaller lengths."""
    t, n, index, probe = max_edits, F.char_length(line), [], []
    for less in range(t + 1):
        m = (n - less).cast("long")
        for i in range(t + 1):
            low, high = (F.floor(m * k / (t + 1)).cast("int") for k in (i, i + 1))
            # A shift fits when the segments before can take it and the rest the others.
            for shift in range(-i, i + 1):
                if abs(less - shift) <= t - i:
                    probe.append(F.xxhash64(m, F.lit(i), F.substring(line, low + shift + 1, high - low)))
            if not less:
                index.append(F.xxhash64(m, F.lit(i), F.substring(line, low + 1, high - low)))
    return F.array(*index), F.array(*probe)


def _narrow(rows: DataFrame, max_edits: int) -> DataFrame:
    """Rows (lid, line, held, key, free) with one more segment in their keys.

    ``free`` are the parts of the index line that need not agree, from lo to hi, and the shifts sl and sr of the probe
    at their ends.  The longest part is cut in max_edits + 1; one of these agrees, as in ``far_keys``.
    """
    t = max_edits
    longest = F.array_max(F.transform("free", lambda x: F.struct((x["hi"] - x["lo"]).alias("w"), (-x["lo"]).alias("o"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["sl"].alias("sl"), x["sr"].alias("sr"))))
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i in range(t + 1) for d in range(-i, i + 1)])
    cut = rows.withColumn("g", longest).withColumn("c", F.explode(cuts)).filter("NOT held OR c.d = 0")
    cut = cut.withColumns({"rest": F.expr("filter(free, x -> x.lo <> g.lo OR x.hi <> g.hi)"), "s": F.expr("g.sl + c.d"), "a": F.expr(f"g.lo + cast(g.w * c.i div {t + 1} as int)"), "b": F.expr(f"g.lo + cast(g.w * (c.i + 1) div {t + 1} as int)")})
    fits = f"abs(g.sr - s) <= {t} - c.i AND a + s >= g.lo + g.sl AND b + s <= g.hi + g.sr AND aggregate(rest, abs(c.d) + abs(g.sr - s), (n, x) -> n + abs(x.sr - x.sl)) <= {t}"
    return cut.filter(fits).select(
        "lid", "line", "held", F.expr("xxhash64(key, c.i, substring(line, a + s + 1, b - a))").alias("key"),
        F.expr("concat(rest, array(named_struct('lo', g.lo, 'hi', a, 'sl', g.sl, 'sr', s), named_struct('lo', b, 'hi', g.hi, 'sl', s, 'sr', g.sr)))").alias("free"),
    )


def far_candidates(distinct: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """Pairs of line ids (a < b) that agree in a segment, and where over ``HOT`` lines share it in more of them."""
    n_lines, found, rows = distinct.count(), [], None
    keys = distinct.select("lid", F.explode("index").alias("key"), F.lit(True).alias("held")).unionByName(distinct.select("lid", F.explode(F.array_distinct("probe")).alias("key"), F.lit(False).alias("held")))
    for left in range(ROUNDS, -1, -1):
        hot = stage(keys.filter("held").groupBy("key").count().filter(F.col("count") > HOT).select("key"), "line-hot", (max_edits + 1) * n_lines // HOT)
        n_hot = hot.count()
        again, shared = left > 0 and n_hot > 0, F.broadcast(hot) if n_hot <= BROADCAST_LINES else hot
        cold = keys.join(shared, "key", "left_anti") if again else keys
        a, b = cold.filter("held").select("key", F.col("lid").alias("a")), cold.filter("NOT held").select("key", F.col("lid").alias("b"))
        found.append(stage(a.join(b, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs"))
        if not again:
            break
        if rows is None:
            texts = _texts(lines, keys.join(shared, "key", "left_semi").select("lid").distinct(), n_lines)
            less = F.explode(F.array(*[F.struct(F.lit(k).alias("less"), F.lit(h).alias("held")) for k, h in [(0, True), *((k, False) for k in range(max_edits + 1))]]))
            whole = texts.withColumn("c", less).select("lid", "line", "c.held", F.expr("char_length(line) - c.less").cast("long").alias("key"), F.expr("array(named_struct('lo', 0, 'hi', char_length(line) - c.less, 'sl', 0, 'sr', c.less))").alias("free"))
            rows = _narrow(whole, max_edits)
        rows = stage(_narrow(rows.join(shared, "key", "left_semi"), max_edits), "line-narrow")
        keys = rows.select("lid", "key", "held").distinct()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stage(out.distinct(), "line-candidates") if len(found) > 1 else out


def _texts(lines: DataFrame, ids: DataFrame, bound: int) -> DataFrame:
    """(lid, line) of the given line ids; the ids are broadcast only while they are few."""
    wanted = stage(ids, "line-wanted", bound)
    few = wanted.count() <= BROADCAST_LINES
    return stage(lines.select(F.xxhash64("line").alias("lid"), "line").join(F.broadcast(wanted) if few else wanted, "lid", "left_semi").distinct(), "line-texts")


def edit_distance(a: str, b: str, max_edits: int) -> str:
    """SQL for the edit distance of columns ``a`` and ``b``, right where it is at most ``max_edits``; their lengths
    must differ by at most that and ``a`` must be longer than it.

    Bit k of a vector stands for row j - max_edits + k of column j.  The value at the band's lower edge is followed
    down the diagonal to the last row, then along that row.
    """
    t = max_edits
    mask, low = (1 << (2 * t + 1)) - 1, 1 << (2 * t)
    match = " | ".join(f"if(coalesce(get(x, j - {t} + {k} - 1) = get(y, j - 1), false) and j - {t} + {k} > 0, {1 << k}L, 0L)" for k in range(2 * t + 1))
    step = f"""transform(array(((((s.p & s.vp) + s.vp) ^ s.vp) | s.p | s.vn) & {mask}L), d0 ->
      transform(array(named_struct('hp', (s.vn | ~(d0 | s.vp)) & {mask}L, 'hn', d0 & s.vp)), h ->
        named_struct('p', 0L,
          'vp', (h.hn | ~(shiftright(d0, 1) | h.hp)) & {mask}L, 'vn', shiftright(d0, 1) & h.hp,
          'd', s.d + if(s.j + {t} <= s.m, if(d0 & {low}L = 0, 1, 0),
                        if(h.hp & shiftleft(1L, s.m - s.j + {t}) <> 0, 1, 0) - if(h.hn & shiftleft(1L, s.m - s.j + {t}) <> 0, 1, 0)),
          'j', s.j, 'm', s.m))[0])[0]"""
    first = mask ^ ((1 << t) - 1)
    return f"""element_at(transform(array(named_struct('x', split({a}, ''), 'y', split({b}, ''))), z ->
      aggregate(transform(sequence(1, size(z.y)), j -> {match.replace("get(x", "get(z.x").replace("get(y", "get(z.y")}),
        named_struct('p', 0L, 'vp', {first}L, 'vn', 0L, 'd', {t}, 'j', 0, 'm', size(z.x)),
        (c, q) -> transform(array(named_struct('p', q, 'vp', c.vp, 'vn', c.vn, 'd', c.d, 'j', c.j + 1, 'm', c.m)), s -> {step})[0],
        c -> c.d)), 1)"""


def line_dedup(docs: DataFrame, max_edits: int = 1, min_chars: int = 20) -> DataFrame:
    """One row per row of ``docs``: row (a struct of every column but text), n_lines, n_removed and text, what stays."""
    if max_edits < 1 or max_edits > 15 or min_chars <= 2 * max_edits:
        raise ValueError("max_edits must be 1 to 15 and min_chars over twice that")
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc"), row_key().alias("__rk"),
        F.split(text_or_empty(), "\n").alias("__lines"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"),
    )
    lines = given.select("__doc", "__rk", F.posexplode("__lines").alias("no", "line")).filter(F.char_length("line") >= min_chars)
    index, probe = segment_keys(F.col("line")) if max_edits == 1 else far_keys(F.col("line"), max_edits)
    where = F.struct(F.col("__doc").alias("doc"), F.col("__rk").alias("rk"), "no")
    distinct = stage(
        lines.select(where.alias("at"), F.unhex(F.sha2("line", 256)).alias("digest"), F.xxhash64("line").alias("lid"), F.char_length("line").alias("n"), index.alias("index"), probe.alias("probe"))
        .groupBy("digest")
        .agg(F.min("at").alias("at"), *[F.any_value(c).alias(c) for c in ("lid", "n", "index", "probe")]),
        "line-distinct",
    )
    pairs = candidates(distinct, lines) if max_edits == 1 else far_candidates(distinct, lines, max_edits)
    known = _texts(lines, pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct(), 2 * pairs.count())
    both = pairs.join(known.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(known.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    near = both.filter(F.abs(F.char_length("x") - F.char_length("y")) <= max_edits).filter(f"({edit_distance('x', 'y', max_edits)}) <= {max_edits}")
    links = near.select(F.unhex(F.sha2("x", 256)).alias("x"), F.unhex(F.sha2("y", 256)).alias("y"))
    place = distinct.select("digest", "at")
    later = (
        links.join(place.select(F.col("digest").alias("x"), F.col("at").alias("at_x")), "x")
        .join(place.select(F.col("digest").alias("y"), F.col("at").alias("at_y")), "y")
        .select(F.when(F.col("at_x") < F.col("at_y"), F.col("y")).otherwise(F.col("x")).alias("digest"))
        .distinct()
    )
    kept = distinct.join(later, "digest", "left_anti").groupBy(F.col("at.doc").alias("__doc"), F.col("at.rk").alias("__rk")).agg(F.collect_list("at.no").alias("__first"))
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    long = F.filter(every, lambda i: F.char_length(F.get("__lines", i)) >= min_chars)
    gone = F.array_except(long, F.coalesce("__first", F.array().cast("array<int>")))
    stays = F.array_except(every, F.col("__gone"))
    return (
        given.join(kept, ["__doc", "__rk"], "left")
        .withColumn("__gone", gone)
        .select(
            F.col("__row").alias("row"), F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"),
            F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n").alias("text"),
        )
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_line_dedup_far(spark, sf_dir: str) -> DataFrame:
    """Lines up to two edits away; the SQL of ``op10_line_dedup`` is written for one."""
    done = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), max_edits=2)
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, no, l[no] AS line FROM (SELECT r, l, unnest(generate_series(1, len(l))) AS no FROM t)),
d AS (SELECT line, min(r * 10000000 + no) AS pos, length(line) AS n FROM e WHERE length(line) >= 20 GROUP BY line),
v AS (SELECT line, pos, n, i, substr(line, 1, i - 1) || substr(line, i + 1) AS less FROM (SELECT line, pos, n, unnest(generate_series(1, n)) AS i FROM d)),
p AS (SELECT a.pos AS u, b.pos AS v FROM v AS a JOIN v AS b ON a.less = b.less AND a.i = b.i AND a.n = b.n AND a.pos < b.pos
      UNION SELECT least(v.pos, d.pos), greatest(v.pos, d.pos) FROM v JOIN d ON v.less = d.line),
g AS (SELECT DISTINCT v AS pos FROM p),
k AS (SELECT pos FROM d WHERE pos NOT IN (SELECT pos FROM g)),
s AS (SELECT e.r, e.no, e.line, length(e.line) < 20 OR k.pos IS NOT NULL AS stays FROM e LEFT JOIN k ON k.pos = e.r * 10000000 + e.no)
SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '')) AS kept_sha256
FROM s JOIN t ON s.r = t.r GROUP BY t.r, t.doc_id
"""

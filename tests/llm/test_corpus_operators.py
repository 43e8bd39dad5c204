"""Every corpus operator against a brute-force version on a small corpus with odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import common, components, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, repeats, skew, substring_dedup, suffix_dedup, token_counts, toxicity, vocab
from brindle.llm.common import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def lists(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1 packing


def test_packing_round_trip(corpus, pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    sequences = set()
    for r in packing.pack(corpus, max_len=64).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.bucket == r.length and r.offset == 0
        assert zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) == r.ids_crc32 and len(r.input_ids) == r.length
        sequences.add(r.sequence_id)
        got[r.doc_id].append((r.start, r.input_ids, r.doc_tokens))
    assert len(sequences) == sum(map(len, got.values()))
    copies = defaultdict(int)
    for doc, _ in pairs:
        copies[doc] += 1
    for doc, text in pairs:
        want = [*t.encode(text, add_special_tokens=False).ids, 1]
        pieces = sorted(got[doc])[:: copies[doc]]
        assert [x for _, ids, _ in pieces for x in ids] == want
        assert [s for s, _, _ in pieces] == np.cumsum([0] + [len(i) for _, i, _ in pieces[:-1]]).tolist() and {n for *_, n in pieces} == {len(want)}


def test_packing_special_strings_and_pieces():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "don't we'll 'tis  's \n's a's's", "x　  y", "١٢ ½ Ⅷ", "İẞ é \U0001f600", ""]
    ids, bounds = packing.ByteLevelEncoder("byte_bpe_50k.json")(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert packing.binary_pieces(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1] and packing.binary_pieces(0, 8) == []
    with pytest.raises(ValueError):
        packing.pack(None, max_len=100)


def test_vocab_cache_overflow():
    for known in (vocab.Known(limit=5), vocab.Known(size_limit=3)):
        for base in range(0, 40, 3):
            words = [bytes([k]) for k in range(base, base + 4)]
            rows = known.rows(words, lambda new: (np.full(len(new), 2), np.repeat([w[0] for w in new], 2)))
            assert vocab.ragged(known.pool, known.at[rows], known.size[rows]).tolist() == np.repeat(range(base, base + 4), 2).tolist()


def thue_morse(n, letters):
    """Two words of equal length that every polynomial hash modulo 2**64 with an odd base gives one value."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_packing_tells_colliding_words_apart():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"x {w} y" for w in thue_morse(1024, "ab")] * 2
    ids, bounds = packing.ByteLevelEncoder("byte_bpe_50k.json")(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# 2 toxicity


def every_segment(score):
    """Maximal scoring segments by their definition: take the best, then look left and right of it."""
    best = max(((sum(score[i : j + 1]), -(j - i), -i, i, j) for i in range(len(score)) for j in range(i, len(score))), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return every_segment(score[:i]) + [(i, j, best[0])] + [(a + j + 1, b + j + 1, s) for a, b, s in every_segment(score[j + 1 :])]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(300):
        score = rng.choice([-3, -2, -1, 2, 3, 5, 7], rng.integers(0, 14)).astype(float) + rng.random() * 0.01
        noise = score + rng.random(len(score)) * 1e-3
        got = toxicity.segments(list(range(len(noise))), noise.tolist(), 0.5)
        want = sorted(every_segment(noise.tolist()))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        w = [f"w{rng.integers(400)}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[rng.integers(60)] = rng.choice(["nasty", f"vilestem{rng.integers(1000)}"])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "nasty nasty vilestemx")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(9999, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels.filter(language_id.remainder(3) != 1))
    got = {r["row"]["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = sum((got[i].score >= 0.7) != bool(rows[i][2]) for i in held)
    assert wrong <= 0.03 * len(held) and got[1002].score > 0.7 and got[1000].score == got[1001].score < 0.5
    assert [(p["first"], p["last"]) for p in got[1002].passages] == [(0, 2)]
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}


# 3 near dedup


def brute_near(pairs, width, percent):
    sets = []
    for _, text in pairs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    top = {d: d for d, _ in pairs}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(pairs[i][0]), root(pairs[j][0])
                top[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d), root(d) == d) for (d, _), s in zip(pairs, sets, strict=True)), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(corpus, pairs, width):
    assert lists(near_dedup.near_dedup(corpus, width), "doc_id", "n_shingles", "component_id", "kept") == brute_near(pairs, width, 80)


def test_near_dedup_in_one_large_region(spark, monkeypatch):
    """Over a hundred near copies in few partitions: regions are larger than the limit and cross borders."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in rng.integers(0, 60, 2):
            t[k] = f"z{rng.integers(50)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "TILE", 20)
    got = lists(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_near(rows, 2, 80)


def test_near_dedup_finds_the_only_link_in_a_large_region(spark):
    """A hundred texts close to one another, and some that are close enough to just one of them."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(100):
        t = list(base)
        for k in rng.choice(100, 3, replace=False):
            t[k] = f"z{rng.integers(10**6)}"
        rows.append((i, t))
    for i in range(100, 112):
        t = list(rows[i - 100][1])
        for k in rng.choice(np.arange(0, 100, 2), 5, replace=False):
            t[k] = f"y{rng.integers(10**6)}"
        rows.append((i, t))
    rows = [(i, " ".join(t)) for i, t in rows]
    got = lists(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_near(rows, 2, 80)


def test_near_dedup_tells_colliding_words_apart(spark):
    a, b = thue_morse(1024, "ab")
    rows = [(1, f"one two {a} three"), (2, f"one two {b} three"), (3, a), (4, b), (5, f"one two {b} three")]
    got = lists(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_near(rows, 2, 80)


def test_near_dedup_takes_rows_with_one_id_as_one_node(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (8, c), (9, ""), (None, c), (None, "v w"), (None, None)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(3, 6, 3, True), (5, 6, 3, False), (5, 6, 3, False), (7, 6, 3, False), (7, 0, 3, False), (8, 6, 8, True), (9, 0, 9, True), (None, 6, 8, False), (None, 1, None, True), (None, 0, None, True)], key=repr)


def test_hot_keys_are_spread(spark, monkeypatch):
    """One key with most of the rows: it is dealt over several tasks, and the result is that of a plain join."""
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "if(id % 10 < 7, 1, id % 5) AS k").repartition(5)
    table = stage(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 4"), "test")
    for limit, how in ((10, "inner"), (10, "left"), (0, "left")):
        monkeypatch.setattr(skew, "BROADCAST_KEYS", limit)
        got = skew.attach(rows, table, ["k"], "n", how)
        want = rows.join(table, "k", how).select(*got.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    sizes = skew.attach(rows, table, ["k"], "n", "left").hint("shuffle_hash")
    assert sizes.count() == 1000


def test_near_dedup_and_exact_dedup_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 120):
        t = list(base)
        t[rng.integers(0, 60)] = f"z{i}"
        rows.append((i, " ".join(t)))
    rows += [(i, f"other text {i}") for i in range(120, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert lists(near_dedup.near_dedup(df, 2), "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, 2, 80)
    assert lists(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2)) if a != b] + [(i, i + 1) for i in range(300, 340)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {(x, root(x)) for x in top if root(x) != x}


# 4 language id


def test_language_id(spark):
    rng = np.random.default_rng(4)
    parts = {"aa": ["th", "ing", "er", "on"], "bb": ["ück", "sch", "ei", "gen"], "cc": ["漢字", "日本", "語の"]}
    rows = [(i, "".join(rng.choice(parts[k], 30)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa"), (901, "12 !?", "aa"), (902, "ingthering", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.filter(language_id.remainder(5) != 0))
    got = {r["row"]["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und", "und", "aa"] and got[900].score == 0
    assert language_id.identify(docs, language_id.learn(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_trigrams_bind_letters():
    counts, has = language_id.trigram_counts(["Ab ab", "", "7"])
    assert has.tolist() == [True, False, False] and np.bincount(counts.text, counts.count, 3).tolist() == [4, 0, 0]
    v = lambda c: language_id.letter_vector(ord(c), 64).astype(int)
    want = 2 * (np.roll(v(" "), 2) * np.roll(v("a"), 1) * v("b")) + 2 * (np.roll(v("a"), 2) * np.roll(v("b"), 1) * v(" "))
    assert language_id.bundle(counts, 64)[0].tolist() == want.tolist()


def plain_bundle(text, dimension):
    """The sum of a text's trigram vectors, one after another."""
    s = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    s = re.sub(" +", " ", s)
    v = {c: language_id.letter_vector(ord(c), dimension).astype(np.int64) for c in set(s)}
    out = np.zeros(dimension, np.int64)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if b != " ":
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_bundles_by_any_way(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(rng.integers(0x4E00, 0x4E00 + 300)) if i % 3 else chr(rng.integers(97, 123)) for _ in range(60)) for i in range(12)] + ["", "Ä b"]
    for cells in (1 << 23, 0):
        counts, _ = language_id.trigram_counts(texts, cells=cells)
        for block, rows in ((2048, 2048), (16, 7), (3, 1)):
            assert np.array_equal(language_id.bundle(counts, 32, block, rows), [plain_bundle(t, 32) for t in texts])
    small = language_id.Letters(8, limit=4)
    for points in ([1, 2, 3], [3, 9], [1, 5, 7]):
        assert np.array_equal(small.table[2, small.rows(points)], [language_id.letter_vector(p, 8) for p in points])


def test_chinese_text_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 680))) for _ in range(512)]
    tracemalloc.start()
    counts, _ = language_id.trigram_counts(texts)
    language_id.bundle(counts, 1024)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 << 20


def test_language_profiles_in_blocks(spark):
    rows = [(i, w * 9, f"l{i % 7}") for i, w in enumerate(["abc", "bcd", "cde", "def", "efg", "fgh", "ghi"] * 3)] + [(90, "7", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, some = (language_id.identify(docs, language_id.learn(docs, block=b), keep_text=True) for b in (500, 2))
    assert lists(one, "row", "text", "lang_pred") == lists(some, "row", "text", "lang_pred") and one.columns == some.columns
    assert max(abs(a.score - b.score) for a, b in zip(*[sorted(x.collect(), key=lambda r: r["row"]["doc_id"]) for x in (one, some)], strict=True)) < 1e-6


# 5 and 6 repeats


def brute_bytes(pairs):
    first = {}
    for doc, text in pairs:
        b = text.encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in pairs:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out, key=repr)


def test_suffix_dedup(corpus, pairs):
    assert lists(suffix_dedup.suffix_dedup(corpus), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(pairs)


def test_suffix_dedup_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    monkeypatch.setattr(repeats, "CHUNK", 40)
    text = " ".join(f"w{i}" for i in range(150))
    rows = [(1, text), (2, "q" + text[100:400] + "r"), (3, text[:60] + "é" * 40 + text[200:])]
    raw, offsets = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for _, t in rows])
    whole = suffix_dedup.minimizers(raw, offsets)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 24)
    once = suffix_dedup.minimizers(raw, offsets)
    assert sum((whole[1] - whole[0] + 1).tolist()) == sum((once[1] - once[0] + 1).tolist())
    assert lists(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)


@pytest.mark.parametrize("operator", ["bytes", "words"])
def test_hot_anchors_are_dealt_by_window(spark, monkeypatch, operator):
    """A passage that many documents share, each with its own surroundings."""
    monkeypatch.setattr(repeats, "HOT", 3)
    rng = np.random.default_rng(11)
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'a{rng.integers(10**6)}' for _ in range(9))} {p} {' '.join(f'b{rng.integers(3)}' for _ in range(9))}") for i in range(30)] + [(None, p), (40, p), (40, p + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = [(1 << 62 if d is None else d, t) for d, t in rows]
    if operator == "bytes":
        got, want = lists(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute_bytes(pairs)
    else:
        got, want = lists(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256"), brute_words(pairs)
    assert got == sorted([(None if r[0] == 1 << 62 else r[0], *r[1:]) for r in want], key=repr)


def test_radix_passes():
    """Windows of five letters, two a pass: the least document of each group of equal windows."""
    contexts = [(b"abcdefgh", 3), (b"xbcdefgh", 1), (b"abcdefzz", 2)]
    windows = lambda c: [c[i : i + 5] for i in range(4)]
    want = {}
    for c, d in contexts:
        for w in windows(c):
            want[w] = min(want.get(w, d), d)
    for digit in (1, 2, 3, 5, 8):
        assert repeats.least_documents(contexts, windows, digit) == [[want[w] for w in windows(c)] for c, _ in contexts]


def brute_words(pairs):
    first = {}
    for doc, text in pairs:
        w = WORD.findall(text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in pairs:
        w = WORD.findall(text)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < doc:
                gone.update(range(i, i + 13))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def test_substring_dedup(corpus, pairs):
    assert lists(substring_dedup.substring_dedup(corpus), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(pairs)


def test_substring_dedup_keeps_text(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(5, f"a {p} b"), (2, f"{p}"), (9, f"x  {p}\ty"), (None, p)]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert got == {5: "a b", 2: p, 9: "x y", None: ""}


# 7 token counts


def test_token_counts(corpus, pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((d, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for d, x in pairs), key=repr)
    assert lists(token_counts.count_tokens(corpus), "doc_id", "n_bytes", "n_tokens") == want


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["<|startoftext|>a<|endoftext|><|endoftext|>", "ΑΣ ΟΔΟΣ", "İstanbul ẞ", "é́", "aaaaaaaaaaaaa hahahahaha", "1234 ½", "a\u0085b c", "don't I'VE '''s", "<|none|>", "\x1c \x00", "a\ua7cbb \ua7dc", "\ua7cb<|endoftext|>", "\u0378 x"]
    assert token_counts.WordCounter("word_bpe_49k.json")(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


# 8 exact dedup


def brute_exact(pairs):
    groups = defaultdict(list)
    for doc, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc))
    return sorted(((d, min(g)[1], len(g), min(g)[1] == d, sha(k)) for k, g in groups.items() for _, d in g), key=repr)


def test_exact_dedup(corpus, pairs):
    assert lists(exact_dedup.exact_dedup(corpus), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(pairs)


def test_exact_dedup_with_colliding_digests(corpus, pairs):
    weak = lambda c: F.char_length(c).cast("string").cast("binary")
    assert lists(exact_dedup.exact_dedup(corpus, salts=3, digest=weak), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(pairs)


# 9 decontamination


def brute_hits(pairs, items, width=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    out = []
    for doc, text in pairs:
        w, hit, ids = split(text), set(), set()
        for k, own in windows.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit.update(range(i, i + len(k)))
                    ids |= own
        out.append((doc, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [250_000, 12])
def test_decontaminate(spark, corpus, pairs, block):
    some = [t for _, t in pairs if len(t.split()) > 30][:3]
    items = [(1, " ".join(some[0].split()[5:25]).upper()), (2, "w1 w2"), (3, None), (4, "!!"), (10, some[1]), (1, some[2]), (11, "Ä"), (12, "é" * 200)]
    found = decontaminate.find_benchmark(corpus, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    got = sorted(((r.doc_id, r.n_words, sum(h["last"] - h["first"] + 1 for h in r.hits), r["items"]) for r in found.collect()), key=repr)
    assert got == brute_hits(pairs, items)
    clean = decontaminate.find_benchmark(corpus, spark.createDataFrame([], "item_id long, text string"))
    assert clean.filter("size(hits) > 0").count() == 0 and clean.count() == len(pairs)


ODD_LETTERS = ["voilà une phrase où l'Å et le à se suivent déjà là-bas", "\u8a00\u8449 \u5168\u90e8 \u5c45\u308b 日本", "привет мир и это ещё одна строка на русском языке вот так да", "a\u00a0b\u0085c \u2028d"]


@pytest.mark.parametrize("block", [250_000, 4])
def test_decontaminate_letters_of_all_kinds(spark, block):
    """Bytes of UTF-8 that are blanks in other encodings are parts of words."""
    rows = [(i, f"x y {t} z, {t.upper()}") for i, t in enumerate(ODD_LETTERS)] + [(9, " ".join(ODD_LETTERS)), (10, "nothing")]
    items = list(enumerate(ODD_LETTERS))
    found = decontaminate.find_benchmark(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    got = sorted(((r.doc_id, r.n_words, sum(h["last"] - h["first"] + 1 for h in r.hits), r["items"]) for r in found.collect()), key=repr)
    assert got == brute_hits(rows, items) and all(n for d, _, n, _ in got if d < 10)


@pytest.mark.parametrize("block", [250_000, 40])
def test_spans_of_blocks_are_merged(spark, block):
    text = " ".join(f"w{i}" for i in range(60))
    r = decontaminate.find_benchmark(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), spark.createDataFrame([(1, text), (2, text[30:])], "item_id long, text string"), block_windows=block).collect()
    assert [([tuple(h) for h in x.hits], [tuple(s) for s in x.spans], x["items"]) for x in r] == [([(0, 59)], [(0, len(text))], ["1", "2"] if text[30:].split()[0] in text.split() else ["1"])] * 2


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "é--One, TWO;three! four")], "doc_id long, text string")
    r = decontaminate.find_benchmark(docs, spark.createDataFrame([(7, "two three")], "item_id long, text string")).first()
    assert [docs.first().text[s["start"] : s["end"]] for s in r.spans] == ["TWO;three"]


# 10 line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(pairs, shortest=20):
    first = {}
    for n, (_, text) in enumerate(pairs):
        for i, line in enumerate(text.split("\n")):
            if len(line) >= shortest:
                first.setdefault(line, (n, i))
    gone = {x for x, p in first.items() if any(q < p and abs(len(x) - len(y)) <= 1 and edits(x, y) <= 1 for y, q in first.items())}
    out = []
    for n, (doc, text) in enumerate(pairs):
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if len(x) < shortest or (first[x] == (n, i) and x not in gone)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(df, **options):
    return sorted(((r["row"]["doc_id"], r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(df, **options).collect()), key=repr)


def test_line_dedup(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdeé "), n)) for n in (10, 19, 20, 21, 40, 41, 90)]
    lines = list(base)
    for _ in range(60):
        x = list(lines[rng.integers(len(lines))])
        for _ in range(rng.integers(0, 3)):
            k, p = rng.integers(3), rng.integers(len(x))
            x[p : p + (k != 0)] = [] if k == 1 else [str(rng.choice(list("xyz")))]
        lines.append("".join(x))
    rows = [(i, "\n".join(str(rng.choice(lines)) for _ in range(rng.integers(1, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, base[5] + "\n" + base[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).repartition(3)
    assert line_rows(df) == brute_lines([(d, t or "") for d, t in rows])


def test_line_dedup_refines_hot_segments(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcde"), 60))
    rows = []
    for i in range(80):
        x = list(base)
        for p in rng.integers(0, 60, rng.integers(1, 3)):
            x[p] = str(rng.choice(list("xyz")))
        rows.append((i, "".join(x[: 60 - rng.integers(0, 2)])))
    assert line_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = np.random.default_rng(most)
    rows = []
    for _ in range(300):
        a = list(rng.choice(list("abé😀"), rng.integers(8, 40)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k, p = rng.integers(3), rng.integers(len(b))
            b[p : p + (k != 0)] = [] if k == 1 and len(b) > 8 else [str(rng.choice(list("abé😀")))]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame([r for r in rows if abs(len(r[0]) - len(r[1])) <= most], "a string, b string").selectExpr("a", "b", f"{line_dedup.edit_distance('a', 'b', most)} AS d")
    for r in df.collect():
        want = edits(r.a, r.b)
        assert r.d == want if want <= most else r.d > most


# all


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        packing.pack(empty), toxicity.score(empty, toxicity.learn(empty, labels)), near_dedup.near_dedup(empty), language_id.identify(empty, language_id.learn(empty.withColumn("lang", F.lit("x")))),
        suffix_dedup.suffix_dedup(empty), substring_dedup.substring_dedup(empty), token_counts.count_tokens(empty), exact_dedup.exact_dedup(empty), decontaminate.find_benchmark(empty, bench), line_dedup.line_dedup(empty),
    ):
        assert df.count() == 0


def test_null_ids(spark):
    """Rows without an id have the values that the docstrings give them."""
    t = "a b c d e f g h i j k l m n " * 4
    rows = [(None, t), (1, t), (None, None), (1, "a b c"), (None, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    tokens = lists(packing.pack(docs).filter("start = 0"), "doc_id", "doc_tokens")
    assert [d for d, _ in tokens] == [1, 1, None, None, None] and sorted(n for d, n in tokens if d is None)[0] == 1
    assert {(r["row"]["doc_id"], r.score) for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()} == {(None, 0.0), (1, 0.0)}
    near = lists(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert near == sorted([(None, 14, 1, False)] * 2 + [(1, 14, 1, True), (1, 1, 1, True), (None, 0, None, True)], key=repr)
    told = lists(language_id.identify(docs, language_id.learn(docs.withColumn("lang", F.lit("x")))), "row", "lang_pred")
    assert [(r[0]["doc_id"], r[1]) for r in told] == [(1, "x"), (1, "x"), (None, "und"), (None, "x"), (None, "x")] or sorted(r[1] for r in told) == ["und", "x", "x", "x", "x"]
    assert lists(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed") == sorted([(None, len(t))] * 2 + [(1, 0), (1, 0), (None, 0)], key=repr)
    assert lists(substring_dedup.substring_dedup(docs), "doc_id", "n_removed") == sorted([(None, 56)] * 2 + [(1, 0), (1, 0), (None, 0)], key=repr)
    assert [r[0] for r in lists(token_counts.count_tokens(docs), "doc_id", "n_tokens")] == [1, 1, None, None, None]
    exact = lists(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert exact == sorted([(None, 1, 3, False)] * 2 + [(1, 1, 3, True), (1, 1, 1, True), (None, None, 1, True)], key=repr)
    hit = sorted(((r.doc_id, r.n_words, len(r.hits)) for r in decontaminate.find_benchmark(docs, bench).collect()), key=repr)
    assert hit == sorted([(None, 56, 4)] * 2 + [(1, 56, 4), (1, 3, 1), (None, 0, 0)], key=repr)
    lines = line_rows(docs)
    assert [(d, n, gone) for d, n, gone, _ in lines] == [(1, 1, 0), (1, 1, 0), (None, 1, 0), (None, 1, 1), (None, 1, 1)] or sorted(x[2] for x in lines) == [0, 0, 0, 1, 1]


def test_repeated_rows_of_exact_dedup(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a  b"), (2, "ab"), (2, "x")]
    got = lists(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (2, 2, 1, True)]


def test_a_very_long_text(spark):
    """A text of 2 MB, a copy of it, and one that ends like it."""
    rng = np.random.default_rng(2)
    t = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 300_000).tolist())
    docs = spark.createDataFrame([(1, t), (2, t), (3, "x " + t[-5000:])], "doc_id long, text string")
    assert lists(near_dedup.near_dedup(docs), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]
    assert lists(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed") == [(1, 0), (2, len(t)), (3, 5000 if t[-5001] != " " else 5001)]
    assert lists(exact_dedup.exact_dedup(docs), "doc_id", "keep_id") == [(1, 1), (2, 1), (3, 3)]
    assert lists(line_dedup.line_dedup(docs), "n_removed") == [(0,), (0,), (1,)]
    from tokenizers import Tokenizer

    for name, got in (("word_bpe_49k.json", token_counts.count_tokens(docs)), ("byte_bpe_50k.json", packing.pack(docs).filter("start = 0").selectExpr("doc_id", "doc_tokens - 1 AS n_tokens"))):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        n = [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in (t, "x " + t[-5000:])]
        assert lists(got, "doc_id", "n_tokens") == [(1, n[0]), (2, n[0]), (3, n[1])]


def test_staged_tables_are_read_back_and_deleted(spark):
    mark = common.staged()
    df, other = stage(spark.range(5), "test"), stage(spark.range(6), "test")
    assert df.count() == 5 and "brindle" in df.inputFiles()[0]
    common.release(mark, but=other)
    path = lambda x: common.Path(x._staged_path.removeprefix("file:"))
    assert not path(df).exists() and path(other).exists() and other.count() == 6
    common.drop(other)
    assert not path(other).exists() and common.staged() == mark

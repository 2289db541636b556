"""Toxicity, lexical search and collocations, and rare cases of other operators, against brute force."""

import collections
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from junctura.llm import queries, op4_language_id, op5_embedding_dedup, op6_sentencepiece, op11_toxicity, op12_lexical_search, op13_collocations


def maximal(scores, start=0):
    """All maximal-scoring segments by their definition: the best one, then those of what is left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return maximal(scores[:i], start) + [(start + i, start + j)] + maximal(scores[j:], start + j)


def test_segments_against_definition():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 25, 40):
        for _ in range(60):
            scores = draw.choice([-3.0, -1.0, -0.5, 0.25, 1.0, 2.5], n) + draw.normal(0, 1e-3, n)
            got = op11_toxicity.segments(scores)
            assert [g[:2] for g in got] == maximal(scores.tolist())
            assert all(abs(s - scores[a:b].sum()) < 1e-9 for a, b, s in got)


def test_segments_take_linear_time():
    n = 300_000
    falling = np.tile([1.0, -1.5], n)  # each segment begins lower than the one before
    assert len(op11_toxicity.segments(falling)) == n
    joined = np.tile([1.0, -0.5], n)  # all are joined
    assert [x[:2] for x in op11_toxicity.segments(joined)] == [(0, 2 * n - 1)]


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(8)
    plain = "the river stone green water light house of and with that".split()
    bad = ["vile", "rotten", "zzgrok", "zzgrim", "zzgrat"]
    rows, marks = [], []
    for i in range(900):
        words = [draw.choice(plain) for _ in range(draw.choice([4, 40, 200]))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(bad) if i % 12 else "zzgr" + draw.choice("abcdefgh") + draw.choice("abcdefgh"))
        rows.append((i, " ".join(words), "src", 1.0))
        marks.append((i, toxic))
    marks += [(901, None), (902, 1), (None, 1), (3, 7)]
    rows += [(901, None, "a", 0.0), (902, "", "a", 0.0), (903, "12 -- !!", "a", 0.0), (None, "zzgrok vile vile rotten", "a", 0.0), (5, "repeated id", "a", 0.0), (904, "water " * 200_000, "a", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, judged double"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, marks = labelled
    model = op11_toxicity.fit(docs, "doc_id", "text", marks, "doc_id", "toxic")
    got = op11_toxicity.score_toxicity(docs, "doc_id", "text", model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    judged = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900 and r.doc_id != 5]
    assert len(judged) > 100 and sum(r.predicted != truth[r.doc_id] for r in judged) <= len(judged) // 50
    by_id = {r.doc_id: r for r in got}
    assert by_id[901].score == by_id[902].score == by_id[903].score == min(r.score for r in got)
    assert by_id[None].predicted == 1 and by_id[None].held_out and by_id[904].predicted == 0
    # passages are where the words are, in code points
    odd = spark.createDataFrame([("é the water zzgrok vile rotten the river ",), (None,)], "text string")
    first, none = op11_toxicity.toxic_passages(odd, "text", model).collect()
    assert [first.text[p.start : p.end] for p in first.passages] == ["zzgrok vile rotten"] and none.passages == []
    assert first.passages[0].expected <= op11_toxicity.SIGNIFICANT


def test_toxicity_without_labels(spark, labelled):
    docs, marks = labelled
    one = op11_toxicity.fit(docs, "doc_id", "text", marks.filter("toxic = 0"), "doc_id", "toxic")
    assert {r.predicted for r in op11_toxicity.score_toxicity(docs.limit(20), "doc_id", "text", one).collect()} == {0}
    none = op11_toxicity.fit(docs, "doc_id", "text", marks.limit(0), "doc_id", "toxic")
    assert {r.score for r in op11_toxicity.score_toxicity(docs.limit(20), "doc_id", "text", none).collect()} == {0.5}
    assert op11_toxicity.score_toxicity(docs.limit(0), "doc_id", "text", one).count() == 0


def test_extreme_value_constants():
    model = op11_toxicity.Model(np.zeros(1), np.zeros(1))
    bins = np.zeros(op11_toxicity.BINS)
    at = lambda score: int((score - op11_toxicity.LEAST) / op11_toxicity.BIN)
    bins[at(-1)], bins[at(1)] = 75, 25
    op11_toxicity._constants(model, bins, [(100, 2.0), (50, 1.0)])
    # 0.75 / x + 0.25 x = 1 has the root x = 3
    assert abs(model.steepness - math.log(3)) < 0.1
    k = 2 / (100 * math.exp(-2 * model.steepness) + 50 * math.exp(-model.steepness))
    assert abs(model.log_k - math.log(k)) < 1e-9


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def searched(docs, items, top=10):
    counts = [(k, collections.Counter(TERMS.findall(lowered(t)))) for k, t in docs]
    counts = [(k, c) for k, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for key, text in items:
        hits = []
        terms = set(TERMS.findall(lowered(text)))
        for k, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                hits.append((-score, math.inf if k is None else k, k))
        out += [(key, i + 1, h[2], -h[0]) for i, h in enumerate(sorted(hits, key=lambda h: h[:2])[:top])]
    return sorted(map(str, out))


def test_search_against_brute_force(spark, docs, texts, empty):
    rows = [(k, t) for k, t, *_ in texts] + [(300 + i, "the same length of words here ok") for i in range(40)] + [(400, "stone " * 30_000 + "été")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, doc string, m int")
    items = [(1, "the stone of a green river, maison"), (1, "lumière et RIVIÈRE pierre verte"), (2, None), (None, "same words here"), (3, "unknownterm"), (4, "!!"), (5, "a text id long")]
    benchmark = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    want = searched(rows, items)
    for postings in (op12_lexical_search.POSTINGS, 300, 1):
        index = op12_lexical_search.build_index(df, "doc_id", "text", postings)
        got = op12_lexical_search.search(index, benchmark, "item_id", "text").collect()
        assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == want
        sizes = index.blocks.selectExpr("octet_length(places) / 2 AS n", "octet_length(docs) / 8 AS d").collect()
        assert all(r.n <= postings or r.d == 1 for r in sizes)
    nothing = op12_lexical_search.build_index(empty, "doc_id", "text")
    assert op12_lexical_search.search(nothing, benchmark, "item_id", "text").count() == 0
    assert op12_lexical_search.search(index, benchmark.limit(0), "item_id", "text").count() == 0


def test_search_in_blocks_of_items(spark, docs, texts, monkeypatch):
    items = [(i, t) for i, (k, t, *_) in enumerate(texts) if i % 20 == 0]
    monkeypatch.setattr(op12_lexical_search, "ITEM_TERMS", 60)
    index = op12_lexical_search.build_index(docs, "doc_id", "text")
    got = op12_lexical_search.search(index, spark.createDataFrame(items, "item_id int, text string"), "item_id", "text", top=3).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == searched([(k, t) for k, t, *_ in texts], items, 3)


def mined(rows, least, closed=100, top=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= closed * candidates[p[i : i + k]]}
        found = []
        for p in candidates.keys() - held:
            score, k = min(((1000 * f[p] * n[lang]) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_against_brute_force(spark, empty):
    draw = random.Random(5)
    vocabulary = ["a", "b", "c", "dé", "E", "ab", "B", "x\x00y", "\x1c", "…"]
    rows = []
    for i in range(300):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b"]) for _ in range(draw.choice([0, 1, 5, 60])))
        rows.append((draw.choice(["en", "en", "en", None, "und", "fr"]), text))
    rows += [("en", None), ("fr", ""), ("de", " .. "), ("en", "b a b a b a b " * 50), ("en", "long " * 50_000)]
    df = spark.createDataFrame([(lang, text, "z", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(5)
    for least, shard_words in ((4, op13_collocations.SHARD_WORDS), (4, 100), (25, 1000)):
        got = op13_collocations.collocations(df, "text", "lang", least, shard_words=shard_words).collect()
        assert sorted(map(tuple, got)) == mined(rows, least)
    got = op13_collocations.collocations(df, "text", "lang", 4, closed_percent=80, top=7).collect()
    assert sorted(map(tuple, got)) == mined(rows, 4, 80, 7)
    assert op13_collocations.collocations(empty, "text", "lang").count() == 0


def test_shards_are_held_one_at_a_time(spark, monkeypatch):
    """Row groups of the index have a shard or two, and a shard's phrases are spelt in parts that add up."""
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.choice([5, 80]))) for _ in range(400)]
    monkeypatch.setattr(op13_collocations, "GROUP_BYTES", 4000, raising=False)
    index = op13_collocations.build_index(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(2), "text", "lang", 500)
    groups = [m.row_group(k).num_rows for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for k in range(m.num_row_groups)]
    assert index.count() > 20 and max(groups) <= 2
    monkeypatch.setattr(op13_collocations, "HELD", 1 << 10)
    rows = pa.RecordBatch.from_pydict({"language": ["en"] * len(texts), "text": texts})
    shards = list(op13_collocations._build(iter([rows]), 1 << 19))
    counts: collections.Counter = collections.Counter()
    for batch in op13_collocations._spelt(iter(shards), [], 7):
        phrases = [p for b in batch.column("phrases").to_pylist() for p in b.decode().split("\n")]
        assert len(phrases) <= 5 << 6
        counts.update(dict(zip(phrases, (n for b in batch.column("counts").to_pylist() for n in np.frombuffer(b, np.int64).tolist()))) if len(set(phrases)) == len(phrases) else {})
    words = [t.split() for t in texts]
    assert len(shards) == 1 and counts == collections.Counter(" ".join(w[i : i + n]) for w in words for n in range(1, 6) for i in range(len(w) - n + 1))


def test_intervals_count_both_ways():
    """Extensions on either side give the same counts as a scan, whatever the order of the extensions."""
    draw = np.random.default_rng(2)
    ids = draw.integers(0, 6, 4000).astype(np.int32)
    ids[[0, -1]] = 0
    hashes = op13_collocations.word_hashes("en", [b".", b"a", b"b", b"c", b"d", b"e"])
    index = op13_collocations.Index(hashes, op13_collocations.transform(ids), op13_collocations.transform(ids[::-1]))
    plain = [collections.Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if (ids[i : i + k] > 0).all()) for k in range(6)]
    for ways in ((True, True, True, True), (False, False, False, False), (True, False, True, False), (False, True, True, False)):
        held = index.words()
        for k, leftwards in enumerate(ways, 2):
            held = index.extended(held, leftwards)
            assert {tuple(w): n for w, n in zip(held.words.tolist(), held.size.tolist())} == plain[k]


def test_counts_by_hash():
    """Packed runs of entries, from several tasks, set the bits of the hashes that reach the least count and no others."""
    draw = np.random.default_rng(4)
    hashes = draw.integers(0, 2**64, 3000, np.uint64)
    counts = draw.choice([1, 3, 254, 255, 256, 600, 70_000], 3000)
    codes = (hashes >> np.uint64(op13_collocations._UNUSED + op13_collocations._BUCKET_BITS - op13_collocations._KEY_BITS)).astype(np.int64)
    parts = [op13_collocations._packed(2, op13_collocations._summed([codes[i::3] << 28 | counts[i::3]])) for i in range(3)] * 2
    rows = pa.Table.from_batches(parts).sort_by([("level", "ascending"), ("bucket", "ascending")]).combine_chunks().to_batches()[0]
    bits = np.zeros((op13_collocations._BUCKETS, 4096), np.uint8)
    for part in op13_collocations._marks(iter([rows.slice(0, 700), rows.slice(700)]), 600):
        bits[part.column(1)[0].as_py()] = np.frombuffer(part.column(2)[0].as_py(), np.uint8)
    bits, at = bits.ravel(), op13_collocations.slots(hashes)
    assert len(bits) * 8 == op13_collocations.MAP_BITS
    assert ((bits[at >> 3] >> (at & 7)) & 1).astype(bool)[2 * counts >= 600].all()
    assert int(np.unpackbits(bits).sum()) == len(set(at[2 * counts >= 600].tolist()))


def test_embeddings_of_any_length(spark):
    """Tiny, huge and subnormal vectors link by their cosine alone."""
    tiny, huge, least = 1e-200, 1e200, 5e-324
    vectors = [[1.0, 2.0], [2.0, 1.0], [tiny, 2 * tiny], [2 * tiny, tiny], [huge, 2 * huge], [-huge, 2 * huge], [least, 2 * least], [2 * least, least], [1.7e308, 1.7e308], [least, 0.0], [0.0, 1e-310], [1e-310, 1.0], [huge, tiny]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in op5_embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label").collect()}
    exact = [[x / max(map(abs, v)) for x in v] for v in vectors]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    want = {i: sum(cosine(a, b) >= 0.93 for j, b in enumerate(exact) if i != j) for i, a in enumerate(exact)}
    assert got == want


def test_language_sample_keeps_rare_languages(spark):
    rows = [(i, f"text {i} of a common language", f"l{i % 99}") for i in range(99 * 60)]
    rare = [i for i in range(10**6, 10**6 + 40) if zlib.crc32(str(i).encode()) % 5][:8]
    df = spark.createDataFrame(rows + [(i, f"text {i} of a rare one", "rare") for i in rare], "doc_id long, text string, lang string").cache()
    for salt in range(20):
        drawn = op4_language_id.sample(df, "doc_id", "text", "lang", rows=1000, salt=salt)
        counts = collections.Counter(r[1] for r in drawn)
        assert counts["rare"] == 8 and len(drawn) <= 1000 and min(counts.values()) >= 8 and len(counts) == 100
    assert op4_language_id.quota_of([5, 5, 5], 9) == 3 and op4_language_id.quota_of([2, 100, 100], 22) == 10 and op4_language_id.quota_of([7] * 50, 10) == 1
    for counts in ([3, 8, 20, 500], [1], [4, 4], [1000] * 7):
        for rows in (1, 10, 50, 600, 10_000):
            quota = op4_language_id.quota_of(counts, rows)
            assert quota == 1 or sum(min(n, quota) for n in counts) <= rows
            assert quota >= max(counts) or sum(min(n, quota + 1) for n in counts) > rows


@pytest.mark.skipif(not os.path.exists(op6_sentencepiece.MODEL), reason="no tokenizer files here")
def test_many_best_segmentations():
    """Combinations of the chunks' lists, for any N, in time that grows with N about linearly."""
    with open(op6_sentencepiece.MODEL, "rb") as file:
        proto = file.read()
    text = "the quick brown fox jumped over"
    for n in (1, 2, 5, 16):
        lattice = op6_sentencepiece.Lattice(proto, n)
        lists = [[s for s, _ in lattice.search(c, n)] for c in op6_sentencepiece.CHUNKS.findall(" " + text)]
        sums = [0.0]
        for scores in lists:
            sums = sorted((a + b for a in sums for b in scores), reverse=True)[:n]
        assert [s for s, _ in lattice.n_best_ids(text)] == pytest.approx(sums)
    lattice = op6_sentencepiece.Lattice(proto, 64)
    got = lattice.n_best_ids(text)
    assert len({tuple(i) for _, i in got}) == len(got) == 64 and {lattice.decode(i) for _, i in got} == {text}
    began = time.perf_counter()
    lattice.n_best_ids(text)
    assert time.perf_counter() - began < 0.1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_columns_that_sql_can_say(spark):
    """Sizes and targets of the mix, and sizes of shards, against SQL over the smallest table."""
    documents = "read_parquet('/root/testdata/sf0.001/documents.parquet')"
    sql = duckdb.connect()
    sizes = f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, source FROM {documents}"
    want = sql.execute(f"SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) FROM ({sizes})").fetchall()
    mixed = queries.op8_mixing_query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in mixed) == sorted(want)
    sources = dict(sql.execute(f"SELECT source, CAST(sum(size) AS BIGINT) FROM ({sizes}) GROUP BY 1").fetchall())
    names = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    # shares stop at twice a source's size, and the rest is shared again by weight until none is above
    budget, full = 1.5 * sum(sources.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = budget - sum(2 * sources[s] for s in full)
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sources[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * sources[s] if s in full else share[s] for s in names}
    of = dict(sql.execute(f"SELECT doc_id, source FROM {documents}").fetchall())
    assert all(r.target == pytest.approx(target[of[r.doc_id]]) for r in mixed)
    shards = queries.op9_sharding_query(spark, "/root/testdata/sf0.001").collect()
    want = sql.execute(f"SELECT doc_id, strlen(coalesce(text, '')) + 16 FROM {documents}").fetchall()
    assert sorted((r.doc_id, r["size"]) for r in shards) == sorted(want)


def test_index_is_written_in_small_row_groups(spark, tmp_path):
    """Tables of large rows have row groups of a bounded size, as each task holds one when it writes or reads."""
    import pyarrow.parquet as pq

    from junctura.functions.checkpoints import shared_table

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "concat_ws(' ', transform(sequence(1, 40), k -> sha2(concat(id, '-', k), 256))) AS terms")
    held = shared_table(rows, group_bytes=1 << 20)
    assert held.count() == 3000
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in held.inputFiles()]
    assert max(groups) > 3

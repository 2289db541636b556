import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import batches, op5_embedding_dedup, op8_mixing, op9_sharding, op10_chat
from junctura.llm.queries import ORACLES, QUERIES


def test_mixing(spark, docs, texts, empty):
    got = op8_mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    assert len(got) == len(texts)
    sizes = {}
    for _, t, _, s, *_ in texts:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, open_ = dict(zip(order, (3, 1, 2, 3, 1, 2))), {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:  # share by weight, cap, share the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = min(2.0 * sizes[s], level * weight[s])
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and math.isclose(r.target, target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)
    again = op8_mixing.mix_sources(docs.repartition(7), "doc_id", "text", "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = op8_mixing.mixed_documents(docs, "doc_id", "text", "source")
    assert mixed.columns == docs.columns and mixed.select(F.sum(op8_mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert op8_mixing.mix_sources(empty, "doc_id", "text", "source").count() == 0


def test_mixing_of_repeated_rows(spark, monkeypatch):
    """A third of all rows are one row: it is taken by number, broadcast or not, and reruns agree."""
    rows = [(1, "five words of a text", "s", "x")] * 400 + [(1, "five words of a text", "s", "y")] * 30 + [(k, "w " * (k % 9), "st"[k % 2], "x") for k in range(2, 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cell string")
    for most in (500_000, 0):
        monkeypatch.setattr(batches, "BROADCAST_ROWS", most)
        got = op8_mixing.mix_sources(df, "doc_id", "text", "source", share=0.7).collect()
        assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
        of_source = {s: sum(r.taken for r in got if r.source == s) for s in "st"}
        assert all(abs(of_source[r.source] - r.target) <= 3 for r in got)
        mixed = op8_mixing.mixed_documents(df, "doc_id", "text", "source", share=0.7)
        counts = sorted(map(tuple, mixed.groupBy(*df.columns).count().collect()))
        assert sum(n * len(t.split()) for _, t, _, _, n in counts) == sum(of_source.values())
        assert counts == sorted(map(tuple, op8_mixing.mixed_documents(df.repartition(5), "doc_id", "text", "source", share=0.7).groupBy(*df.columns).count().collect()))


def test_fit_counts_reaches_the_budget():
    draw = np.random.default_rng(1)
    for _ in range(60):
        lengths = sorted(draw.choice(np.arange(1, 400), 25, replace=False).tolist())
        counts = draw.integers(1, 9, 25).tolist()
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = int(draw.integers(0, total + 1))
        taken = op8_mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        reach = 1
        for n, c in zip(lengths, counts):
            for _ in range(c):
                reach |= reach << n
        best = max(s for s in range(budget + 1) if reach >> s & 1)
        assert budget - best - 2 <= sum(n * t for n, t in zip(lengths, taken)) <= budget


def test_sharding(spark, docs, texts, empty):
    for shards in (1, 7, 40):
        got = op9_sharding.shard_rows(docs, "doc_id", "text", shards).collect()
        n = len(texts)
        assert sorted((r.shard, r.slot) for r in got) == sorted((p % shards, p // shards) for p in range(n))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(k), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in texts)
    again = op9_sharding.shard_rows(docs.repartition(5), "doc_id", "text", 40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert [r.row_index for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))][-1] == n - 1
    assert op9_sharding.shard_rows(empty, "doc_id", "text", 40).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 255, 257, 5000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(op9_sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))
    if n == 5000:
        assert got != sorted(got) and abs(np.corrcoef(got, range(n))[0, 1]) < 0.05


def test_permutation_against_plain_integers(spark):
    """The network and the walk, step by step with Python's own integers."""
    for n, seed in ((1, 3), (7, 3), (1000, 9), (4097, 20_240_601)):
        a, b = op9_sharding.halves(n)
        assert a * b >= n and a * b - n < a

        def walk(x):
            left, right = x % a, x // a
            for i, (p, q, s) in enumerate(op9_sharding.round_keys(seed)):
                y = (right % 2_147_483_647 * p + q) % 2_147_483_647
                y = y * y % 2_147_483_647 * s % 2_147_483_647
                left, right = right, (left + y) % (a if i % 2 == 0 else b)
            return left + right * a

        want = []
        for x in range(n):
            x = walk(x)
            while x >= n:
                x = walk(x)
            want.append(x)
        assert [r[0] for r in spark.range(n).select(op9_sharding.permuted(F.col("id"), n, seed)).collect()] == want


def test_written_shards(spark, docs, tmp_path):
    rows = op9_sharding.shard_rows(docs, "doc_id", "text", 3)
    op9_sharding.write_shards(rows, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "a\\|<|im_end|>\n"), (1, 1, "assistant", "\\\\<\\|x"), (1, 2, "assistant", None), (2, 0, "system\n<|x", ""), (2, 0, "assistant", said), (2, 0, "assistant", said), (None, None, None, "é"), (3, 500, "user", "late"), (3, 3, "user", "early")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = op10_chat.format_chats(df, "conv_id", "turn", "role", op10_chat.text_parts(F.col("text")))
    back = {r.conv_id: r for r in got.select("conv_id", "formatted", "loss_spans", op10_chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "a\\|<|im_end|>\n"), ("assistant", "\\\\<\\|x"), ("assistant", "")]
    assert [(t.role, t.text) for t in back[2].turns] == [("assistant", said), ("assistant", said), ("system\n<|x", "")]
    assert [(t.role, t.text) for t in back[None].turns] == [("", "é")]
    assert [t.text for t in back[3].turns] == ["early", "late"]
    spans = back[2].loss_spans
    assert [back[2].formatted[s.start : s.start + s.length] for s in spans] == [said.replace("<|", "<\\|")] * 2
    assert got.limit(0).count() == 0
    pieces = {r.conv_id: r for r in got.select("conv_id", op10_chat.turns_of(F.col("blocks")).alias("turns"), op10_chat.masked_text(F.col("blocks")).alias("loss")).collect()}
    assert all(pieces[k].turns == back[k].turns for k in back) and pieces[2].loss == said * 2 and pieces[1].loss == "\\\\<\\|x"


def test_chat_of_many_turns(spark):
    """A conversation over several blocks, with clashing names, reads back in order from its pieces and from the whole."""
    turns = [(1, k, "assistant" if k % 2 else "user", f"t{k} <|im_end|>\\") for k in range(1000)]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, block string, formatted string")
    row = op10_chat.format_chats(df, "conv_id", "turn", "role", op10_chat.text_parts(F.col("text"))).withColumns({"turns": op10_chat.turns_of(F.col("blocks")), "loss": op10_chat.masked_text(F.col("blocks"))}).first()
    assert len(row.blocks) == 4 and "".join(b.formatted for b in row.blocks) == row.formatted
    assert [(t.role, t.text) for t in row.turns] == [t[2:] for t in turns] and row.loss == "".join(t[3] for t in turns if t[2] == "assistant")
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == [t[3].replace("\\", "\\\\").replace("<|", "<\\|") for t in turns if t[2] == "assistant"]


def test_chat_parts(spark):
    kind = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", 85), ("text", " and <|image|>", None, None), ("document", None, "b.pdf", None), ("video", None, "c", 7)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"c long, t long, r string, p {kind}")
    row = op10_chat.format_chats(df, "c", "t", "r", F.col("p")).first()
    assert row.formatted == "<|im_start|>user\nsee <|image|> and <\\|image|><|document|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "s3://a.png", 85), ("document", "b.pdf", 0), ("video", "c", 7)] and row.expanded_tokens == 92


def test_embeddings_against_brute_force(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 24))
    rows = []
    for i in range(900):
        v = centres[i % 40] + draw.normal(size=24) * draw.choice([0.0, 0.15, 0.3, 0.9])
        rows.append((i, v.astype(np.float32).tolist(), i % 3))
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [None] + [1.0] * 23, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [1.0, 2.0], 1), (None, rows[1][1], 1), (907, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, size int")
    got = {r.vec_id: r for r in op5_embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label").collect()}
    x = np.array([r[1] for r in rows[:900]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (np.arange(900)[:, None] % 3 == np.arange(900)[None] % 3)
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    found = np.array([got[i].n_links - int(i == 1 or bool(linked[i, 1])) for i in range(900)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    assert got[905].n_links == 1 and got[906].component_id == 905 and not got[906].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (900, 901, 902, 903, 904, 907))
    assert got[None].component_id is None and not got[None].kept
    assert op5_embedding_dedup.near_duplicates(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_passes_follow_the_largest_label(spark):
    assert [op5_embedding_dedup.passes_for(n) for n in (0, 1, 500, 10**5, 10**6, 10**7)] == [12, 12, 12, 18, 29, 45]
    draw = np.random.default_rng(4)
    a, b = draw.normal(size=(2, 2000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    both = np.stack([a, 0.932 * a + np.sqrt(1 - 0.932**2) * b], axis=1).reshape(4000, 24)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = op5_embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label", window=1).filter("n_links > 0").count()
    assert got >= 0.98 * 4000


def test_windows_cross_the_borders_of_ranges(spark):
    draw = np.random.default_rng(8)
    rows = [(i, (draw.normal(size=24) if i % 2 else np.full(24, 1.0) + 0.3 * draw.normal(size=24)).tolist(), 1) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    held, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = op5_embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label", passes=1, window=8, recall=0.0)
            found.append(sorted(map(tuple, out.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == found[1] and any(r[1] for r in found[0])


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)

import hashlib
import itertools
import os
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import batches, op1_quality, op2_lz_fingerprint, op3_jaccard_join, op4_language_id, op6_sentencepiece, op7_pii


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_jaccard_against_all_pairs(spark, docs, texts, empty):
    got = op3_jaccard_join.jaccard_components(docs, "doc_id", "text").collect()
    assert len(got) == len(texts)
    rows = [(k, shingle_set(t)) for k, t, *_ in texts]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if a[0] is not None and b[0] is not None and a[1] and 100 * len(a[1] & b[1]) >= 80 * len(a[1] | b[1]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, s) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    want = sorted((str(k), len(s), str(None if k is None else least[top(i)] if s else k)) for i, (k, s) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert op3_jaccard_join.jaccard_components(empty, "doc_id", "text").count() == 0


def test_jaccard_of_a_large_loose_group(spark, monkeypatch):
    """Copies that mostly don't link to each other: heavy shingles, pivots and blocks must find the same components."""
    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in draw.choice(150, int(draw.integers(1, 8)), replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t) for _, t in rows]
    labels = list(range(120))
    for i, j in itertools.combinations(range(120), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and labels[i] != labels[j]:
            labels = [min(labels[i], labels[j]) if x in (labels[i], labels[j]) else x for x in labels]
    assert 1 < len(set(labels)) < 120
    # as it is; with room for four heavy classes, a full filter, one pivot, and shuffles in place of broadcasts
    monkeypatch.setattr(op3_jaccard_join, "BLOCK", 32)
    for changes in ({}, {"HEAVY_TABLE": 4, "MOST_BITS": 11, "PIVOTS": 1}):
        for name, value in changes.items():
            monkeypatch.setattr(op3_jaccard_join, name, value)
        if changes:
            monkeypatch.setattr(batches, "BROADCAST_ROWS", 0)
        got = {r.doc_id: r.component_id for r in op3_jaccard_join.jaccard_components(df, "doc_id", "text").collect()}
        assert got == dict(enumerate(labels))


def test_first_of_each(spark, docs, texts):
    """One row of each group stays; different texts under one id, texts without words and rows without an id are left alone."""
    kept = op3_jaccard_join.first_of_each(docs.unionByName(docs.filter("doc_id = 3")), "doc_id", "text")
    assert kept.columns == docs.columns
    rows = kept.collect()
    by_id = {r.doc_id: r.component_id for r in op3_jaccard_join.jaccard_components(docs.filter("doc_id IS NOT NULL AND doc_id != 7"), "doc_id", "text").collect()}
    assert {r.doc_id for r in rows if r.doc_id not in (None, 7)} == {k for k, c in by_id.items() if k == c}
    assert sum(r.doc_id == 3 for r in rows) == 1 and sum(r.doc_id == 7 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert {190, 191, 192} <= {r.doc_id for r in rows}


def test_pii_against_regular_expressions(spark, docs, texts, empty):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]

    odd = ["a@b@c.de", "a@b.c@d.e", "x@y..z", "1.2.3.4.5.6.7.8", "1 2--3", "++1 (2) 3-4.5 67890", "4539-1488-0343-6467 4539148803436467", "@", "+", "a@b.c.", "0000.1.1.1", "tel:+1.+2 345 678 90"]
    for t in odd + [t for _, t, *_ in texts if t]:
        assert [s for s in op7_pii.spans_of(t) if s[0] in op7_pii.BASE_KINDS] == base(t), t
    got = op7_pii.find_pii(docs, "doc_id", "text")
    assert got.count() == len(texts) and op7_pii.find_pii(empty, "doc_id", "text").count() == 0
    row = got.filter("doc_id = 196").select(op7_pii.told(F.col("spans"))).first()[0]
    assert row.startswith("email:5:14,ip:27:36,card:38:57,phone:59:77")
    masked = op7_pii.redact_pii(docs, "text")
    assert masked.columns == docs.columns and masked.filter("doc_id = 196").first().text == "mail [EMAIL], 10.0.0.256 [IP], [CARD], [PHONE] ok"
    account = lambda t: [t[a:b] for kind, a, b in op7_pii.spans_of(t) if kind == "account"]
    assert account("IBAN GB82 WEST 1234 5698 7654 32 AND MORE WORDS") == account("IBAN GB82 WEST 1234 5698 7654 32") == ["GB82 WEST 1234 5698 7654 32"]
    assert account("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"] and account("iban:GB82WEST12345698765432x") == account("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert op7_pii.spans_of("x" * 50 + "://user@host")[0] == ("url", 0, 62)


def test_pii_takes_time_in_proportion():
    for text in ("1" * 10**6, "1." * 500_000, "a@" * 300_000, "+1" * 300_000, "http://" * 100_000, "1-" * 300_000, "x" * 10**6 + "://u@h"):
        began = time.perf_counter()
        op7_pii.spans_of(text)
        assert time.perf_counter() - began < 20


def test_fingerprints(spark, docs, texts, empty):
    got = op2_lz_fingerprint.edit_likeness(docs, "doc_id", "text").collect()
    assert len(got) == len(texts)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    known = sorted((k, t) for k, t, *_ in texts if k is not None and k != 7 and 7 < k < 189)
    for (k, t), (_, following) in zip(known, known[1:]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert by_id[k][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_id[k][0].edited_fingerprint == op2_lz_fingerprint.as_hex(op2_lz_fingerprint.signature(edited))
        assert by_id[k][0].fingerprint == op2_lz_fingerprint.as_hex(op2_lz_fingerprint.signature(t))
    assert by_id[191][0].fingerprint == by_id[190][0].fingerprint and by_id[190][0].n_chars == 0
    one = op2_lz_fingerprint.edit_likeness(docs.filter("doc_id = 12"), "doc_id", "text").first()
    assert one.near_next == 1.0
    assert op2_lz_fingerprint.edit_likeness(empty, "doc_id", "text").count() == 0

    def phrases(t):
        seen, w = set(), ""
        for c in t:
            w += c
            if w not in seen:
                seen.add(w)
                w = ""
        return seen

    a, b = texts[1][1] * 3, texts[1][1] * 2 + texts[3][1]
    exact = len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b))
    assert abs(op2_lz_fingerprint.likeness(op2_lz_fingerprint.signature(a), op2_lz_fingerprint.signature(b)) - exact) < 0.25


def test_likeness_is_that_of_the_phrase_sets():
    """64 minima estimate the share of common phrases: exact sets of plain strings say what it should be."""
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]

    def phrases(t):
        seen, w = set(), ""
        for c in t:
            w += c
            if w not in seen:
                seen.add(w)
                w = ""
        return seen

    wrong = []
    for share in np.linspace(0, 1, 40):
        a = draw.choice(words, 300).tolist()
        b = a[: int(share * 300)] + draw.choice(words, 300 - int(share * 300)).tolist()
        a, b = " ".join(a), " ".join(b)
        exact = len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b))
        wrong.append(abs(exact - op2_lz_fingerprint.likeness(op2_lz_fingerprint.signature(a), op2_lz_fingerprint.signature(b))))
    assert np.mean(wrong) < 0.06 and max(wrong) < 0.2
    text = " ".join(draw.choice(words, 200_000))
    assert op2_lz_fingerprint.as_hex(op2_lz_fingerprint.signature(text)) == op2_lz_fingerprint.as_hex(op2_lz_fingerprint.signature(text + text[:0]))


def test_language(spark, docs, texts, empty):
    net = op4_language_id.fit(docs, "doc_id", "text", "lang")
    got = op4_language_id.predict_languages(docs, "doc_id", "text", net).collect()
    assert len(got) == len(texts)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r for r in got if r.doc_id != 7}
    assert all(by_id[k].lang_pred == "und" for k in (190, 191, 192, 193))
    fair = [(by_id[k].lang_pred, lang) for k, t, lang, *_ in texts if k is not None and k < 160 and k != 7 and by_id[k].held_out]
    assert np.mean([a == b for a, b in fair]) >= 0.9
    assert op4_language_id.fit(empty, "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in op4_language_id.predict_languages(docs, "doc_id", "text", None).collect()} == {"und"}
    # tables over byte pairs give what the filters give
    scorer = op4_language_id.Scorer(net)
    raw = np.frombuffer("le maison the house".encode().ljust(256, b"\0"), np.uint8)[None]
    x = np.where(raw[..., None] > 0, net.embed[raw], 0)
    short = np.stack([x[0, i : i + 2].ravel() @ net.short + net.short_bias for i in range(255)]).max(0)
    long = np.stack([x[0, i : i + 4].ravel() @ net.long + net.long_bias for i in range(253)]).max(0)
    z = np.maximum(np.concatenate([short, long]), 0) @ net.dense + net.dense_bias
    assert np.allclose(scorer.windows(raw)[0], z - np.log(np.exp(z - z.max()).sum()) - z.max(), atol=1e-3)


def test_quality(spark, docs, texts, empty):
    junk = [(1000 + i, "*** " * 30 + f"buy {i} now !!!") for i in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t, *_ in texts] + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, None) for k in range(0, 160)] + [(k, 0, 1) for k, _ in junk] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    net = op1_quality.fit(rows, "doc_id", "text", labels, "doc_id", "quality")
    got = op1_quality.score_quality(rows, "doc_id", "text", net).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    fair = [(r.predicted, int(r.doc_id < 1000)) for r in got if r.held_out and r.doc_id is not None and (r.doc_id < 160 or r.doc_id >= 1000)]
    assert np.mean([a == b for a, b in fair]) >= 0.9
    none = op1_quality.fit(docs, "doc_id", "text", labels.limit(0), "doc_id", "quality")
    assert {r.score for r in op1_quality.score_quality(docs, "doc_id", "text", none).collect()} == {0.5}
    assert op1_quality.score_quality(empty, "doc_id", "text", none).count() == 0


def test_word_vectors_against_plain_loops(spark):
    """Sums of the neighbours' index vectors, word by word, and their weights."""
    texts = ["the river of the house", "House THE 42 ... of", None, "", "a", "b b b b"]
    got = op1_quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    memo, sums, counts = op1_quality._Buckets(), {}, {}
    for t in texts:
        ids = [memo[w] for w in op1_quality.TOKENS.findall(t or "")]
        for i, one in enumerate(ids):
            counts[one] = counts.get(one, 0) + 1
            vector = sums.setdefault(one, np.zeros(op1_quality.DIMENSIONS))
            for j in range(max(0, i - op1_quality.REACH), min(len(ids), i + op1_quality.REACH + 1)):
                if i != j:
                    for place, sign in zip(op1_quality.PLACES[ids[j]], op1_quality.SIGNS[ids[j]]):
                        vector[place] += sign
    for one, vector in sums.items():
        weight = 1e-3 / (1e-3 + counts[one] / sum(counts.values()))
        assert np.allclose(got.vectors[one], vector / max(np.linalg.norm(vector), 1e-9) * weight, atol=1e-6)
    pooled = got.pool(np.array([memo["the"], memo["of"]]))
    assert np.allclose(pooled[: op1_quality.DIMENSIONS], (got.vectors[memo["the"]] + got.vectors[memo["of"]]) / 2, atol=1e-6)


def test_very_long_texts(spark):
    """A text of a million signs among short ones is taken whole by each operator of texts."""
    long = " ".join(f"word{i % 977} house" for i in range(100_000))
    rows = [(1, long, "en"), (2, long + " end", "en"), (3, "the house", "en"), (4, None, None)] + [(k, f"le {k} maison", "fr") for k in range(5, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = op4_language_id.fit(df, "doc_id", "text", "lang")
    assert op4_language_id.predict_languages(df, "doc_id", "text", net).count() == len(rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, quality int")
    scored = op1_quality.score_quality(df, "doc_id", "text", op1_quality.fit(df, "doc_id", "text", labels, "doc_id", "quality")).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    told = {r.doc_id: r for r in op2_lz_fingerprint.edit_likeness(df, "doc_id", "text").collect()}
    assert told[1].n_chars == len(long) and told[1].near_next > 0.9
    linked = {r.doc_id: r for r in op3_jaccard_join.jaccard_components(df, "doc_id", "text").collect()}
    assert linked[2].component_id == 1 and linked[1].n_shingles == len(shingle_set(long))
    assert op7_pii.find_pii(df, "doc_id", "text").filter("size(spans) > 0").count() == 0


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pii_query_against_regular_expressions(spark):
    """Counts and digest of the base kinds over the whole table."""
    from junctura.llm.queries import QUERIES

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for k, t in docs:
        t = t or ""
        of = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]]
        of += [[m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]]
        of += [[m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]]
        of += [[m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]]
        told = ",".join(f"{kind}:{a}:{b}" for kind, spans in zip(op7_pii.BASE_KINDS, of) for a, b in spans)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(map(len, of))
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()


MODEL = op6_sentencepiece.MODEL


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files here")
def test_sentencepiece(spark, docs, texts, empty):
    with open(MODEL, "rb") as file:
        lattice = op6_sentencepiece.Lattice(file.read())

    def all_paths(chunk):
        """Every segmentation, from the pieces alone."""
        text = chunk.replace(" ", "▁") if chunk != "▁" else "▁"
        pieces = {} if chunk == "▁" else lattice.pieces
        paths = {0: [(0.0, ())]}
        for j in range(1, len(text) + 1):
            paths[j] = [(s + pieces[text[i:j]][1], p + (pieces[text[i:j]][0],)) for i in range(j) if text[i:j] in pieces for s, p in paths[i]]
            if text[j - 1] not in pieces:
                paths[j] += [(s + lattice.worst, p + (text[j - 1],)) for s, p in paths[j - 1]]
        return sorted(((s, lattice.ids(list(p))) for s, p in paths[len(text)]), key=lambda x: -x[0])

    for chunk in (" hello", " there", "  x", "ñandú", " a", "▁", "\n", "!!", "日本", "aaaaaaaa", "        "):
        want = all_paths(chunk)
        got = lattice.search(chunk, 4)
        assert [s for s, _ in want[:4]] == [s for s, _ in got] and len({i for _, i in got}) == len(got) and set(got) <= set(want)
        ids, best, gap = lattice.chunk(chunk)
        assert best == want[0][0] and ids == got[0][1] and gap == pytest.approx(want[0][0] - want[1][0] if len(want) > 1 else float("inf"))
    text = "the house▁ of\n\n été  x"
    best = lattice.n_best_ids(text)
    assert len({tuple(i) for _, i in best}) == len(best) and all(lattice.decode(i) == text for _, i in best)
    small = " the cat"
    both = sorted((a[0] + b[0] for a in all_paths("  the") for b in all_paths(" cat")), reverse=True)
    assert [s for s, _ in lattice.n_best_ids(small)] == both[:4]
    coded = op6_sentencepiece.encode_texts(docs, "doc_id", "text")
    rows = coded.collect()
    assert len(rows) == len(texts) and all(r.round_trip in (None, True) for r in rows)
    for r in rows:
        if r.ids is not None:
            every = [op6_sentencepiece.changed(r.ids, c) for c in r.n_best_changes]
            assert every[0] == r.ids and len({tuple(x) for x in every}) == len(every) == len(r.n_best_scores)
            assert len({lattice.decode(x) for x in every}) == 1 and r.n_best_scores == sorted(r.n_best_scores, reverse=True)
    back = op6_sentencepiece.decode_ids(coded, "doc_id", "ids")
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(t) for _, t, *_ in texts)
    assert op6_sentencepiece.encode_texts(empty, "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files here")
@pytest.mark.parametrize("sign", ["a", " ", "="])
def test_sentencepiece_of_one_long_run(sign):
    """Equally good segmentations by the million cost time and memory in proportion to the text."""
    with open(MODEL, "rb") as file:
        lattice = op6_sentencepiece.Lattice(file.read())
    text = sign * 10**5
    tracemalloc.start()
    ids, _, told = lattice.encode(text)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert lattice.decode(ids) == text and len(told) == 4
    began = time.perf_counter()
    assert lattice.decode(lattice.encode(text * 4)[0]) == text * 4 and time.perf_counter() - began < 60

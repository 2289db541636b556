"""SentencePiece encoding and decoding by N-best search over the piece lattice.

The pieces and scores of a given model span a lattice over a text. Forward Viterbi
scores are exact heuristics for an A-star search backward from the end, which so
meets the N best segmentations in order; the ids of every text come from it. What a path loses against the best is summed
instead of its score, so an edge of the best path costs exactly nothing. Every open
path can be completed at no further loss and no two give the same segmentation, so the N least open ones are all that is held. Among equal losses the
path that has come nearest to the start goes on first. Many equally good segmentations
of a long run of one sign so cost no more than N walks over it. An edge without loss is gone on with at once, as nothing open can
be better. Only the forward scores of a long chunk are held, and its edges are looked up again.

No piece joins other signs to a space
after them or holds a line feed, so the lattice falls apart at those places: each
chunk is searched by itself, and the text's N best are the best combinations of
the chunks'. A chunk's gap to its second best segmentation says whether it matters. The N best of a text are told by
their scores and by what they change in the best one.

Characters without a piece fall back to byte pieces, at a penalty below every
score. The space sign U+2581 itself is also written as bytes, so decoding gives
back every text exactly.

Edge cases: a null text gives nulls; an empty text no pieces, the one
segmentation with score 0; texts of any length are encoded whole, and a chunk
without spaces of any length is one lattice; repeated rows are encoded each; an
empty table gives no rows. Only the key is carried beside the results. The model's bytes
(a fixed file) are read on the driver and broadcast; tokenizers are never trained.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from junctura.llm.batches import bounded, kept, lighter

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Spaces with the letters, or with the other signs, after them. The superscript two counts as a sign.
CHUNKS = re.compile(f" *[^\\W\\d_²]+| *(?:[^ \n{SPACE}\\w]|[\\d_²])+| +|\n|{SPACE}")
N_BEST = 4
MEMO = 300_000
#: Signs of the longest chunk that is remembered from text to text.
SHORT = 64
PENALTY = 10.0
#: Pieces below this are reserved by the model; they serve only where nothing else does.
RESERVED = -1e8


class _Memo(dict):
    """Chunks seen, up to ``MEMO`` of them; others are searched again."""

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, chunk: str) -> tuple[bytes, float, float]:
        got = self.lattice.chunk(chunk)
        if len(self) < MEMO and len(chunk) <= SHORT:
            self[chunk] = got
        return got


@kept
def lattice_of(proto: bytes, n_best: int = 4) -> Lattice:
    """A worker's lattice, kept from task to task with the short chunks that it remembers, a bounded number. Tasks of other operators let it go."""
    return Lattice(proto, n_best)


class Lattice:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes, n_best: int = N_BEST):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.n_best = n_best
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.pieces[piece] = (i, model.get_score(i))
                self.raw.append(piece.replace(SPACE, " ").encode())
        if any(len(CHUNKS.findall(p.replace(SPACE, " "))) > 1 for p in self.pieces):
            raise ValueError("a piece crosses a chunk border")
        self.worst = min((s for _, s in self.pieces.values() if s > RESERVED), default=0.0) - PENALTY
        self.singles = {p for p in self.pieces if len(p) == 1}
        #: Lengths of the pieces that end with a sign, the longest first.
        self.lengths: dict[str, list[int]] = {}
        for n, c in sorted({(len(p), p[-1]) for p in self.pieces}, reverse=True):
            self.lengths.setdefault(c, []).append(n)
        #: Finds all pieces in a text, by end and the longest first: (signs, id, score).
        self.finder = ahocorasick.Automaton()
        for piece, (number, score) in self.pieces.items():
            self.finder.add_word(piece, (len(piece), number, score))
        self.finder.make_automaton()
        self.memo = _Memo(self)
        self.ranked: dict[str, list[tuple[float, bytes]]] = {}
        self.long: dict[str, list[tuple[float, bytes]]] = {}

    def found(self, text: str) -> Iterator[tuple[int, tuple[int, object, float]]]:
        """(end, (signs, id, score)) of the pieces in a text by end; a sign without a piece gives itself in place of an id, at the penalty."""
        pieces = self.finder.iter(text)
        if self.singles.issuperset(text):
            return pieces
        others = ((k, (1, c, self.worst)) for k, c in enumerate(text) if c not in self.singles)
        return heapq.merge(pieces, others, key=itemgetter(0))

    def forward(self, text: str) -> list[float]:
        """Best score from the start to each place of a text."""
        best = [0.0] + [float("-inf")] * len(text)
        for j, (size, _, score) in self.found(text):
            j += 1
            score += best[j - size]
            if score > best[j]:
                best[j] = score
        return best

    def lattice(self, text: str) -> tuple[list[float], list[list[tuple[int, object, float]]]]:
        """The forward scores of a short text, and the edges (signs, id or sign, score) that end at each place, the longest first."""
        best = [0.0] + [float("-inf")] * len(text)
        into: list[list[tuple[int, object, float]]] = [[] for _ in best]
        for j, edge in self.found(text):
            j += 1
            into[j].append(edge)
            score = best[j - edge[0]] + edge[2]
            if score > best[j]:
                best[j] = score
        return best, into

    def edges(self, text: str, end: int) -> list[tuple[int, object, float]]:
        """The edges that end at a place, looked up."""
        pieces = self.pieces
        parts = [(n, *pieces[p]) for n in self.lengths.get(text[end - 1], ()) if n <= end and (p := text[end - n : end]) in pieces]
        return parts if text[end - 1] in self.singles else [*parts, (1, text[end - 1], self.worst)]

    def ids(self, labels: list[object]) -> bytes:
        """Piece ids, four bytes each; a character in their place gives its bytes' ids."""
        try:
            return array("i", labels).tobytes()
        except TypeError:  # a sign among them
            pass
        out: list[int] = []
        for x in labels:
            if isinstance(x, str):
                out += [self.bytes[b] for b in x.encode()]
            else:
                out.append(x)
        return array("i", out).tobytes()

    def chunk(self, chunk: str) -> tuple[bytes, float, float]:
        """Ids and score of the best segmentation, and the gap to the second best (infinite if there is none).

        The search for one segmentation of a short chunk, written out: it only goes on with edges without loss, and the
        least loss among the edges it leaves open is that of the next one.
        """
        if len(chunk) > SHORT:
            found = self.ranking(chunk)
            return found[0][1], found[0][0], found[0][0] - found[1][0] if len(found) > 1 else float("inf")
        if chunk == SPACE:
            return self.ids([SPACE]), self.worst, float("inf")
        best, into = self.lattice(chunk.replace(" ", SPACE))
        node, gap, labels = len(chunk), float("inf"), []
        while node:
            top, further = best[node], -1
            for size, label, score in into[node]:
                lost = top - (best[node - size] + score)
                if lost == 0.0 and further < 0:
                    further = node - size
                    labels.append(label)
                elif lost < gap:
                    gap = lost
            node = further
        labels.reverse()
        return self.ids(labels), best[-1], gap

    def search(self, chunk: str, count: int) -> list[tuple[float, bytes]]:
        """The ``count`` best segmentations of a chunk, best first: A-star from the end with the forward scores."""
        if chunk == SPACE:
            return [(self.worst, self.ids([SPACE]))]
        text = chunk.replace(" ", SPACE)
        best, into = self.lattice(text) if len(text) <= SHORT else (self.forward(text), None)
        open_: list[tuple[float, int, int, tuple | None]] = [(0.0, len(text), 0, None)]
        turn, found = 0, []
        while open_ and len(found) < count:
            loss, node, _, path = open_.pop(0)
            room = count - len(found) - 1
            while node:
                top, further = best[node], None
                for edge in self.edges(text, node) if into is None else into[node]:
                    size, label, score = edge
                    i = node - size
                    lost = top - (best[i] + score)
                    if lost == 0.0 and further is None:
                        further = edge
                        continue
                    lost += loss
                    if len(open_) < room or room and (lost < open_[-1][0] or lost == open_[-1][0] and i < open_[-1][1]):
                        turn += 1
                        insort(open_, (lost, i, turn, (label, score, path)))
                        del open_[room:]
                size, label, score = further
                node -= size
                path = (label, score, path)
            labels, total = [], 0.0
            while path:
                label, score, path = path
                labels.append(label)
                total += score
            found.append((total, self.ids(labels)))
        return sorted(found, key=lambda x: -x[0])

    def encode(self, text: str) -> tuple[array, float, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Ids and score of the best segmentation, and the N best: the score of each, and (place, pieces to drop, ids to put there)."""
        if not text:
            return array("i"), 0.0, [(0.0, [])]
        self.long.clear()
        chunks = CHUNKS.findall(" " + text)
        pieces, scores, gaps = zip(*map(self.memo.__getitem__, chunks))
        ids = array("i", b"".join(pieces))
        total = sum(scores)
        ends = list(accumulate(map(len, pieces), initial=0))
        told = []
        for lost, changes in self._losses(chunks, gaps):
            told.append((total - lost, [(ends[k] // 4, len(pieces[k]) // 4, self.ranking(chunks[k])[rank][1]) for k, rank in changes]))
        return ids, total, told

    def ranking(self, chunk: str) -> list[tuple[float, bytes]]:
        """The N best segmentations of a chunk. A limited number of short ones is remembered, and the long ones of the text at hand."""
        held = self.ranked if len(chunk) <= SHORT else self.long
        found = held.get(chunk)
        if found is None:
            found = self.search(chunk, self.n_best)
            if held is self.long or len(held) < MEMO // 10:
                held[chunk] = found
        return found

    def _losses(self, chunks: list[str], gaps: tuple[float, ...]) -> list[tuple[float, tuple]]:
        """The N least losses against the best, each with its changes (chunk place, rank)."""
        if self.n_best < 2:
            return [(0.0, ())]
        # a gap that no second segmentation leaves is infinite
        limit = min(heapq.nsmallest(self.n_best - 1, gaps)[-1], sys.float_info.max)
        single = []
        for k in [k for k, gap in enumerate(gaps) if gap <= limit]:
            found = self.ranking(chunks[k])
            single += [(found[0][0] - s, k, rank) for rank, (s, _) in enumerate(found[1:], 1)]
            if len(single) > 64:
                single = heapq.nsmallest(self.n_best - 1, single)
        single = heapq.nsmallest(self.n_best - 1, single)
        by_chunk: dict[int, list[tuple[float, int]]] = {}
        for lost, k, rank in single:
            by_chunk.setdefault(k, []).append((lost, rank))
        # chunk by chunk: of sums of two ascending lists, the N least are among those whose places multiply to N at most
        options: list[tuple[float, tuple]] = [(0.0, ())]
        for k, found in by_chunk.items():
            more = [(a + lost, (*changes, (k, rank))) for j, (lost, rank) in enumerate(found, 2) for a, changes in options[: self.n_best // j]]
            options = heapq.nsmallest(self.n_best, options + more)
        return options

    def n_best_ids(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text, best first."""
        ids, _, told = self.encode(text)
        return [(score, changed(ids.tolist(), [(at, drop, array("i", new).tolist()) for at, drop, new in changes])) for score, changes in told]

    def decode(self, ids) -> str:
        """The text of a segmentation, without the space put before it."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def changed(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """``ids`` after changes ``(at, drop, ids)``, whose places are those before any change."""
    out = list(ids)
    for at, drop, new in sorted(changes, reverse=True):
        out[at : at + drop] = new
    return out


def encode_texts(df: DataFrame, key: str, text: str, model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """``key, ids, n_pieces, score, n_best_scores, n_best_changes, round_trip`` of every row.

    The k-th best segmentation has the k-th of the scores, and is ``ids`` with the k-th of the changes: an array of
    ``struct<at, drop, ids>`` that says how many pieces to replace from which place on (see ``changed``).
    """
    with open(model, "rb") as file:
        proto = df.sparkSession.sparkContext.broadcast(file.read())
    field = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(proto.value, n_best)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield _coded(batch.slice(at, 1024), lattice, key)
        lattice.ranked.clear()
        lattice.long.clear()

    changes = "array<array<struct<at:int,drop:int,ids:array<int>>>>"
    return bounded(df, lean=True).select(key, text).mapInArrow(lighter(run, keeps=lattice_of), f"`{key}` {field}, ids array<int>, n_pieces long, score double, n_best_scores array<double>, n_best_changes {changes}, round_trip boolean")


def _coded(part: pa.RecordBatch, lattice: Lattice, key: str) -> pa.RecordBatch:
    flat, offsets, missing, counts, scores, same = array("i"), [0], [], [], [], []
    of_text, best, of_best, places, drops, of_change, new = [0], [], [0], [], [], [0], array("i")
    for t in part.column(1).to_pylist():
        missing.append(t is None)
        ids, score, told = lattice.encode(t or "")
        flat.extend(ids)
        offsets.append(len(flat))
        counts.append(None if t is None else len(ids))
        scores.append(None if t is None else score)
        for value, changes in told if t is not None else ():
            best.append(value)
            for place, drop, put in changes:
                places.append(place)
                drops.append(drop)
                new.frombytes(put)
                of_change.append(len(new))
            of_best.append(len(places))
        of_text.append(len(best))
        same.append(None if t is None else lattice.decode(ids) == t)
    whole = lambda x: pa.array(x, pa.int32())
    ints = lambda x: pa.array(memoryview(x), pa.int32()) if len(x) else whole([])
    gone = pa.array(missing)
    lists = pa.ListArray.from_arrays(whole(offsets), ints(flat), mask=gone)
    change = pa.StructArray.from_arrays([whole(places), whole(drops), pa.ListArray.from_arrays(whole(of_change), ints(new))], names=["at", "drop", "ids"])
    changes = pa.ListArray.from_arrays(whole(of_text), pa.ListArray.from_arrays(whole(of_best), change), mask=gone)
    columns = [part.column(0), lists, pa.array(counts, pa.int64()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(whole(of_text), pa.array(best, pa.float64()), mask=gone), changes, pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=[key, "ids", "n_pieces", "score", "n_best_scores", "n_best_changes", "round_trip"])


def decode_ids(df: DataFrame, key: str, ids: str, model: str = MODEL) -> DataFrame:
    """``key, text``: the text of every row's ids; null ids give a null text."""
    with open(model, "rb") as file:
        proto = df.sparkSession.sparkContext.broadcast(file.read())
    field = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(proto.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else lattice.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {field}, text string")

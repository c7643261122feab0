"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary. Each language has a probability for
every piece, fitted by expectation maximisation over words; a forward algorithm sums the
probability of all segmentations of a word, and a text's log-likelihood is the sum over its words.

Words are runs of letters of the lower-cased text (bytes beyond ASCII count as letters), each with
a leading space, of any length. A word falls into parts where no piece crosses, whose sums multiply; long parts
are summed by logarithms, so that nothing underflows.
All words of a batch are scored at once; distinct ones are remembered by their hash, up to MEMO.

Learning reads a bounded sample: about `train_docs` documents of each language (by a hash of the
id, so at any size it is the same share of each partition), of which only word counts leave the executors.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the
first language by name; repeated rows are judged alike; without any labelled row every text is
`und`; a very long text is scored whole, in time linear in it, block by block where it has words; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, tidy
from .hashing import segment_hashes
from .tokens import vocabulary_path

TRAIN_DOCS = 1500
ROUNDS = 3
MEMO, BLOCK = 1_000_000, 1 << 20
#: Bytes of a part up to which plain products cannot underflow, of a piece's prefix that is looked up first, of words in one lattice.
PLAIN, PREFIX, CHUNK = 40, 8, 1 << 18
FLOOR = 0.05  # expected count that every piece has besides what was seen

_WORD = np.zeros(256, bool)
_WORD[97:123] = True
_WORD[128:] = True


def byte_pieces(path: str | None = None) -> list[bytes]:
    """The vocabulary's pieces as bytes: all that can occur in a lower-cased word, and every single byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such vocabularies write as themselves
    names = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    out = set()
    for w in words:
        raw = bytes(names[c] for c in w) if all(c in names for c in w) else b""
        if raw and all(_WORD[b] for b in raw.removeprefix(b" ")):
            out.add(raw)
    out |= {bytes([b]) for b in range(256) if _WORD[b]} | {b" "}
    return sorted(out)


def lower_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first word of each row with the total last); a start is at the space before the word."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(offsets) - 1
    # a space before every row makes room for the leading space of its first word
    data, offsets = np.insert(data, offsets[:-1], 32), offsets + np.arange(n + 1)
    data = np.where(_WORD[data], data, np.uint8(32))
    word = data != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts = edge[word[edge]]
    ends = edge[~word[edge]]
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    starts = starts - 1
    return data, starts, ends, np.searchsorted(starts, offsets)


class Pieces:
    """The pieces by hash; their ids are their places in the list."""

    def __init__(self, pieces: list[bytes]):
        n = np.array([len(p) for p in pieces])
        ends = np.cumsum(n)
        data, starts = np.frombuffer(b"".join(pieces), np.uint8), ends - n
        keys = segment_hashes(data, starts, ends)
        self.ids = np.argsort(keys)
        self.keys = keys[self.ids]
        self.sizes = np.unique(n).tolist()
        long_ = n > PREFIX
        self.prefixes = np.unique(segment_hashes(data, starts[long_], starts[long_] + PREFIX))

    def found(self, keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def _log_sums(values: np.ndarray, groups: np.ndarray, members: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, groups, axis=0)
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, members, axis=0)), groups, axis=0))


class Lattice:
    """All occurrences of pieces (edges) in a list of words, which are cut into parts where no piece crosses.

    A part of n bytes has n + 1 nodes; edges are ordered by the place in the part where they end, then by part.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = ends - starts
        base = np.cumsum(n) - n
        total = int(n.sum())
        own = data[np.repeat(starts - base, n) + np.arange(total)]
        left = np.repeat(base + n, n) - np.arange(total)
        at, size, ids = [], [], []
        begins = None
        for k in pieces.sizes:
            here = np.flatnonzero(left >= k) if begins is None else begins[left[begins] >= k]
            if not len(here):
                break
            i, good = pieces.found(segment_hashes(own, here, here + k), pieces.keys)
            at.append(here[good])
            size.append(np.full(good.sum(), k))
            ids.append(pieces.ids[i[good]])
            if k <= PREFIX < min([x for x in pieces.sizes if x > k], default=0):
                long_ = np.flatnonzero(left > PREFIX)
                begins = long_[pieces.found(segment_hashes(own, long_, long_ + PREFIX), pieces.prefixes)[1]]
        at, size, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, size, ids))
        crossed = np.cumsum(np.bincount(at + 1, minlength=total + 2) - np.bincount(at + size, minlength=total + 2))[:total]
        first = np.flatnonzero(crossed == 0)  # parts begin there; the first byte of a word is never inside a piece
        self.words = np.searchsorted(first, base)
        self.length = np.diff(np.append(first, total))
        part = np.searchsorted(first, at, side="right") - 1
        stop = at + size - first[part]
        order = np.lexsort((part, stop))
        self.part, self.stop, self.id = part[order], stop[order], ids[order]
        self.begin = at[order] + self.part
        self.end = self.begin + size[order]
        self.first = first + np.arange(len(first))
        self.nodes = total + len(first)

    def _steps(self, chosen: np.ndarray, by: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(edges, first of each node's edges, how many) for each place of the parts; `chosen` is ordered by place, then part, and `by` names the node."""
        node = by[chosen]
        place = self.stop[chosen] if by is self.end else (self.begin - self.first[self.part])[chosen]
        edge = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        for a, b in zip(edge, np.append(edge[1:], len(chosen)), strict=True):
            groups = np.append(0, np.flatnonzero(np.diff(node[a:b])) + 1)
            yield chosen[a:b], groups, np.diff(np.append(groups, b - a))

    def log_likelihood(self, log_prob: np.ndarray) -> np.ndarray:
        """Of each word, summed over all segmentations, for each column of log_prob (pieces by languages)."""
        wide = log_prob.shape[1]
        out = np.full((len(self.length), wide), -np.inf)
        plain = self.length <= PLAIN
        alpha = np.zeros((self.nodes, wide))
        alpha[self.first] = 1.0
        prob = np.exp(log_prob)
        chosen = np.flatnonzero(plain[self.part])
        if len(chosen):
            for edges, groups, _ in self._steps(chosen, self.end):
                alpha[self.end[edges[groups]]] = np.add.reduceat(alpha[self.begin[edges]] * prob[self.id[edges]], groups, axis=0)
            with np.errstate(divide="ignore"):
                out[plain] = np.log(alpha[(self.first + self.length)[plain]])
        chosen = np.flatnonzero(~plain[self.part])
        if len(chosen):
            out[~plain] = self.forward(log_prob, chosen)[(self.first + self.length)[~plain]]
        return np.add.reduceat(out, self.words, axis=0) if len(self.words) else np.zeros((0, wide))

    def forward(self, log_prob: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """By logarithms: of each node the sum over all ways to it."""
        alpha = np.full((self.nodes, log_prob.shape[1]), -np.inf)
        alpha[self.first] = 0.0
        for edges, groups, members in self._steps(chosen, self.end):
            alpha[self.end[edges[groups]]] = _log_sums(alpha[self.begin[edges]] + log_prob[self.id[edges]], groups, members)
        return alpha

    def expected(self, log_prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over words with weights, for one language (one column)."""
        every = np.arange(len(self.id))
        if not len(every):
            return np.zeros(len(log_prob))
        alpha = self.forward(log_prob, every)[:, 0]
        beta = np.full((self.nodes, 1), -np.inf)
        beta[self.first + self.length] = 0.0
        by_begin = np.lexsort((self.part, self.begin - self.first[self.part]))
        for edges, groups, members in reversed(list(self._steps(by_begin, self.begin))):
            beta[self.begin[edges[groups]]] = _log_sums(beta[self.end[edges]] + log_prob[self.id[edges]], groups, members)
        whole = alpha[self.first + self.length][self.part]
        share = np.exp(alpha[self.begin] + log_prob[self.id, 0] + beta[self.end, 0] - whole)
        weight = np.repeat(weight, np.diff(np.append(self.words, len(self.length))))
        return np.bincount(self.id, share * weight[self.part], len(log_prob))


class Model:
    """Piece probabilities per language; languages times pieces numbers, bounded by the vocabulary."""

    def __init__(self, languages: list[str], pieces: list[bytes], prob: np.ndarray):
        self.languages, self.log_prob, self.pieces = languages, np.log(prob), Pieces(pieces)
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, prob.shape[1]), np.float32)

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the distinct words, which of them each word is)."""
        keys, first, back = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMO:
            self.keys, self.scores = self.keys[:0], self.scores[:0]
        i = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(i, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            found = np.concatenate([Lattice(self.pieces, data, a[i:j], b[i:j]).log_likelihood(self.log_prob) for i, j in slices(np.append(0, np.cumsum(b - a)), CHUNK)])
            self.keys, self.scores = np.insert(self.keys, i[new], keys[new]), np.insert(self.scores, i[new], found.astype(np.float32), axis=0)
            i = np.searchsorted(self.keys, keys)
        return self.scores[i], back

    def text_scores(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood of each row by language."""
        data, starts, ends, rows = lower_words(column)
        out = np.zeros((len(rows) - 1, self.log_prob.shape[1]))
        if len(starts):
            scores, back = self.word_scores(data, starts, ends)
            full = np.flatnonzero(rows[1:] > rows[:-1])
            out[full] = np.add.reduceat(scores[back].astype(np.float64), rows[:-1][full], axis=0)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample_word_counts(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, word, n) over about train_docs documents of each language; `labelled` has doc_id, text, lang."""
    sizes = labelled.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return labelled.sparkSession.createDataFrame([], "lang string, word binary, n long")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["count"]))])
    picked = labelled.where(F.col("lang").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            data, starts, ends, rows = lower_words(batch.column("text"))
            if not len(starts):
                continue
            keys = segment_hashes(data, starts, ends)
            lang = np.repeat(code, np.diff(rows))
            _, first, n = np.unique(keys ^ (lang.astype(np.uint64) << np.uint64(56)), return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[first])), pa.array(words, pa.binary()), pa.array(n)], ["lang", "word", "n"])

    return picked.select("lang", "text").mapInArrow(tidy(count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(counts: pa.Table, vocabulary: str | None = None, rounds: int = ROUNDS) -> Model | None:
    """Expectation maximisation for each language over its word counts."""
    pieces = byte_pieces(vocabulary)
    table = Pieces(pieces)
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return None
    columns = []
    for lang in languages:
        own = counts.filter(pc.equal(counts.column("lang"), lang)).sort_by("word")
        words, n = own.column("word").to_pylist(), own.column("n").to_numpy().astype(np.float64)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        cuts = slices(np.append(0, ends), 16 * CHUNK)
        lattices = [(Lattice(table, data, ends[i:j] - sizes[i:j], ends[i:j]), n[i:j]) for i, j in cuts]
        prob = np.full(len(pieces), 1 / len(pieces))
        for _ in range(rounds):
            seen = sum(lattice.expected(np.log(prob)[:, None], w) for lattice, w in lattices) + FLOOR
            prob = seen / seen.sum()
        columns.append(prob)
    return Model(languages, pieces, np.stack(columns, 1))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) per row: the likeliest language and its posterior under equal priors."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            text = batch.column("text")
            _, offsets = text_buffer(text)
            for i, j in slices(offsets, BLOCK):
                part = text.slice(i, j - i)
                bare = np.array([not (t and any(map(str.isalpha, t))) for t in part.to_pylist()])
                if model is None:
                    names, score = ["und"] * (j - i), np.zeros(j - i)
                else:
                    s = model.text_scores(part)
                    best = s.argmax(1)
                    score = 1 / np.exp(np.maximum(s - s.max(1, keepdims=True), -700)).sum(1)
                    names = ["und" if b else model.languages[k] for b, k in zip(bare, best, strict=True)]
                    score = np.where(bare, 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(predict), f"doc_id {id_type}, lang_pred string, score double")


def fit_and_identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from rows that are not held out, predicts all."""
    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    model = fit(sample_word_counts(learn, train_docs).toArrow(), vocabulary)
    return identify(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and for every single byte, so that any text has one). The
score of a word is the sum over all its segmentations into pieces of the product of their probabilities, found by the forward algorithm; a
text's is the product over its words. Probabilities are learned with expectation-maximisation from all distinct labelled texts (with
``max_train_docs``, from a sample of about so many). A word's part in it depends on its counts in each language alone, so texts are read once, to count
their words, and the rounds run over the distinct words. The forward algorithm runs over the distinct words of a batch, all of them at once place by place; through words of over 64 bytes it
runs one by one in blocks, carrying only the sums of the last positions, so a text without blanks is summed over all its segmentations too.
Pieces with a mark of a word's start inside can't occur in a word and are left out.

Defined cases: a null text or one without a letter gets ``und`` and score 0; rows without lang teach nothing, nor do null texts; copies of a
text count once a language, and each language has one text at least; without any labelled text all get ``und``; equal posteriors go to the
language that sorts first; extra columns are ignored by the digest and carried by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles
from .storage import materialize
from .textscan import any_in_rows, by_bytes, mix, row_ids, scan_words, text_buffer

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Words of more bytes are summed in blocks with sums that are scaled again and again.
LONGEST = 64
#: Bytes of words in one lattice, about.
LATTICE = 256 << 10
#: Words that a task remembers with their scores.
KNOWN = 500_000
BLOCK = 1 << 15
#: A factor for every byte, which keeps products of probabilities of 64 bytes within the range of floats.
SCALE = 2.0**9


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as a hash table of byte strings. A word begins with the byte 1, which stands for the mark of a word's start."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                text = model.id_to_piece(i).replace("▁", "\x01").encode()
                if b"\x01" not in text[1:]:
                    found.add(text)
        self.texts = sorted(found)
        self.longest = max(map(len, self.texts))
        # pieces and their beginnings: a start is followed no further than it can lead to a piece
        number = {t: k for k, t in enumerate(self.texts)}
        begun = sorted({t[:k] for t in self.texts for k in range(1, len(t) + 1)})
        keys = np.array([self._hash(t) for t in begun], _U)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], np.array([number.get(t, -1) for t in begun], np.int32)[order]
        slots = (self.keys >> _U(44)).astype(np.int64)
        self.first = np.full((1 << 20) + 1, self.keys.size - 1, np.int32)
        self.first[: 1 << 20] = np.minimum(np.searchsorted(slots, np.arange(1 << 20)), self.keys.size - 1)
        self.fullest = int(np.bincount(slots).max())

    @staticmethod
    def _hash(text: bytes) -> int:
        h = np.zeros(1, _U)
        for b in text:
            h = h * _BASE + _U(b + 1)
        return int(mix(h)[0])

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of a piece or of the beginning of one, and the pieces' numbers (-1: only a beginning)."""
        m = mix(h)
        at = self.first[(m >> _U(44)).astype(np.int64)]
        hit = self.keys[at] == m
        for k in range(1, self.fullest):
            rest = np.flatnonzero(~hit)
            there = np.minimum(at[rest] + k, self.keys.size - 1)
            good = self.keys[there] == m[rest]
            at[rest[good]], hit[rest[good]] = there[good], True
        found = np.flatnonzero(hit)
        return found, self.number[at[found]]

    def ending(self, word: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of the pieces in one word that end in (a, b], in the order of their ends."""
        low, found = max(0, a - self.longest + 1), []
        start, h = np.arange(low, b), np.zeros(b - low, _U)
        for size in range(1, self.longest + 1):
            inside = start + size <= b
            start, h = start[inside], h[inside]
            if not start.size:
                break
            h = h * _BASE + (word[start + size - 1].astype(_U) + _U(1))
            on, piece = self.lookup(h)
            start, h, whole = start[on], h[on], piece >= 0
            found.append((start[whole], start[whole] + size, piece[whole]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.flatnonzero(end > a)
        order = order[np.argsort(end[order], kind="stable")]
        return start[order], end[order], piece[order]


class Lattice:
    """All segmentations of many words of at most ``LONGEST`` bytes at once, as a graph.

    Words go by falling length (``order``), and a place in them is a node: first all words' starts, then their ends of one byte, of two, and so on. Edges are
    pieces. What leads to one place of all words is summed in one step, so a batch takes as many steps as its longest word has bytes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces, marked: bool = False):
        """``marked``: the words' first byte is the mark of their start; otherwise it is put before them."""
        self.order = np.argsort(-sizes, kind="stable")
        starts, self.sizes = starts[self.order], sizes[self.order] + (not marked)
        n = int(self.sizes[0])
        #: words with a byte at each place, and the first node of each place
        self.counts = np.searchsorted(-self.sizes, -np.arange(n), "left")
        self.nodes = np.concatenate([[0, self.sizes.size], self.sizes.size + np.cumsum(self.counts)])
        text = np.concatenate([np.ones(self.sizes.size, np.uint8) if not marked and k == 0 else data[starts[:c] + (k - (not marked))] for k, c in enumerate(self.counts.tolist())])
        place, word = np.repeat(np.arange(n), self.counts), np.concatenate([np.arange(c) for c in self.counts])
        h, found = np.zeros(text.size, _U), []
        for size in range(1, pieces.longest + 1):
            inside = place + size <= self.sizes[word]
            place, word, h = place[inside], word[inside], h[inside]
            if not h.size:
                break
            h = h * _BASE + (text[self.nodes[place + size] - self.sizes.size + word].astype(_U) + _U(1))
            on, piece = pieces.lookup(h)
            place, word, h, whole = place[on], word[on], h[on], piece >= 0
            found.append((self.nodes[place[whole]] + word[whole], self.nodes[place[whole] + size] + word[whole], piece[whole]))
        begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        self.begin, self.end, self.piece = begin[order], end[order], piece[order]
        #: every node but the starts is the end of a piece: single bytes are pieces
        self.into = np.searchsorted(self.end, np.arange(self.sizes.size, self.nodes[-1] + 1))

    def ahead(self, chance: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of what is before each node; ``chance``: of each edge, in one language."""
        sums = np.ones(self.nodes[-1])
        first = self.sizes.size
        for a, b in zip(self.nodes[1:-1].tolist(), self.nodes[2:].tolist(), strict=True):
            i, j = self.into[a - first], self.into[b - first]
            sums[a:b] = np.add.reduceat(sums[self.begin[i:j]] * chance[i:j], self.into[a - first : b - first] - i)
        return sums

    def last(self) -> np.ndarray:
        """The node of each word's end, in the order the words were given."""
        out = np.empty(self.sizes.size, np.int64)
        out[self.order] = self.nodes[self.sizes] + np.arange(self.sizes.size)
        return out

    def behind(self, chance: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of what is after each node."""
        order = np.argsort(self.begin, kind="stable")
        # nodes with an edge out of them: all but the words' ends
        begin, end = self.begin[order], self.end[order]
        out = np.flatnonzero(np.append(True, begin[1:] != begin[:-1]))
        inner, out = begin[out], np.append(out, begin.size)
        sums, chance = np.ones(self.nodes[-1]), chance[order]
        bounds = np.searchsorted(inner, self.nodes)
        for k in range(self.counts.size - 1, -1, -1):
            a, b = bounds[k], bounds[k + 1]
            i, j = out[a], out[b]
            sums[inner[a:b]] = np.add.reduceat(sums[end[i:j]] * chance[i:j], out[a:b] - i)
        return sums


def forward(words: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of prefixes: [end, word, language], for a matrix of words of one length. ``table``: probability of each piece in each language, times SCALE to the power of its size."""
    count, n = words.shape
    graph = Lattice(np.ascontiguousarray(words).ravel(), np.arange(count) * n, np.full(count, n), pieces, marked=True)
    return np.stack([graph.ahead(table[graph.piece, k]) for k in range(table.shape[1])], 1).reshape(n + 1, count, -1)


def _add_expected(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, pieces: Pieces, table: np.ndarray, total: np.ndarray, marked: bool = False) -> None:
    """Add expected counts of the pieces to ``total``. Most words occur in one language: each language has a lattice of its own words."""
    for k in range(table.shape[1]):
        on = np.flatnonzero(weights[:, k])
        if not on.size:
            continue
        graph = Lattice(data, starts[on], sizes[on], pieces, marked)
        chance = table[graph.piece, k]
        ahead, behind = graph.ahead(chance), graph.behind(chance)
        scale = (weights[on, k] / np.maximum(ahead[graph.last()], 1e-300))[graph.order]
        # the word of an edge: its end's number less that of the first node of its place
        word = graph.end - np.repeat(graph.nodes[:-1], np.diff(graph.nodes))[graph.end]
        total[:, k] += np.bincount(graph.piece, ahead[graph.begin] * chance * behind[graph.end] * scale[word], total.shape[0])


def expected(words: np.ndarray, weights: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces, by language, in words of one length with the given counts in each language."""
    count, n = words.shape
    out = np.zeros_like(table)
    _add_expected(np.ascontiguousarray(words).ravel(), np.arange(count) * n, np.full(count, n), weights, pieces, table, out, marked=True)
    return out


def _scaled_window(sums: np.ndarray, logs: np.ndarray | None, low: int, high: int, scale: np.ndarray) -> np.ndarray:
    """Bring rows low to high - 1 back to a size of about one, and return the logarithm of their factor."""
    most = sums[low:high].max(0)
    most[most <= 0] = 1
    sums[low:high] /= most
    scale = scale + np.log(most)
    if logs is not None:
        logs[low:high] = scale
    return scale


def _ahead(word: np.ndarray, a: int, b: int, carry: np.ndarray, scale: np.ndarray, pieces: Pieces, table: np.ndarray):
    """Forward sums of the ends in (a, b]. ``carry``: those of the last ``longest`` ends up to a, in units of exp(``scale``).

    Returns the sums from a - longest + 1 on, the logarithms of their units, the unit of the last ones, and the pieces: rows of their starts and ends, numbers, probabilities.
    """
    width = pieces.longest
    start, end, piece = pieces.ending(word, a, b)
    begins, ends, chance = start - a + width - 1, end - a + width - 1, table[piece]
    first = np.searchsorted(end, np.arange(a + 1, b + 2)).tolist()
    sums, logs = np.zeros((width + b - a, table.shape[1])), np.zeros((width + b - a, table.shape[1]))
    sums[:width], logs[:width] = carry, scale
    for k in range(b - a):
        i, j, row = first[k], first[k + 1], width + k
        sums[row], logs[row] = np.einsum("ij,ij->j", sums[begins[i:j]], chance[i:j]), scale
        if k & 15 == 15:
            scale = _scaled_window(sums, logs, row - width + 1, row + 1, scale)
    return sums, logs, scale, (begins, ends, piece, chance)


def long_word(word: np.ndarray, pieces: Pieces, table: np.ndarray, weight: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """The logarithm of the sum over all segmentations of one word of any length, by language. With ``weight``, its expected counts are added to ``total``."""
    width, n = pieces.longest, word.size
    carry, scale, kept = np.zeros((width, table.shape[1])), np.zeros(table.shape[1]), []
    carry[-1] = 1
    for a in range(0, n, BLOCK):
        kept.append((a, carry, scale))
        sums, _, scale, _ = _ahead(word, a, min(a + BLOCK, n), carry, scale, pieces, table)
        carry = sums[-width:].copy()
    whole = np.log(carry[-1]) + scale
    if weight is None:
        return whole
    behind, back_scale = np.zeros((width, table.shape[1])), np.zeros(table.shape[1])
    behind[-1] = 1
    for a, carry, scale in reversed(kept):
        b = min(a + BLOCK, n)
        sums, logs, _, (begins, ends, piece, chance) = _ahead(word, a, b, carry, scale, pieces, table)
        first = np.searchsorted(ends, np.arange(width, width + b - a + 1)).tolist()
        back, back_logs = np.zeros_like(sums), np.zeros_like(logs)
        back[-width:] = behind
        for k in range(b - a - 1, -1, -1):
            i, j, row = first[k], first[k + 1], width + k
            back_logs[row] = back_scale
            back[begins[i:j]] += chance[i:j] * back[row]
            if k & 15 == 0:
                back_scale = _scaled_window(back, None, row - width, row, back_scale)
        behind = back[:width].copy()
        share = sums[begins] * chance * back[ends] * np.exp(logs[begins] + back_logs[ends] - whole)
        np.add.at(total, piece, share * weight)
    return whole


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """The distinct words of a batch: matrices of those of one length, each with the index of its words, and the long ones with their index; then the index of each word of the text, its row, and how many are distinct."""
    starts, lengths, hashes, bounds = scan_words(data, offsets, fold=False)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    groups, size = [], lengths[first]
    for n in np.unique(size[size <= LONGEST]).tolist():
        at = np.flatnonzero(size == n)
        words = np.ones((at.size, n + 1), np.uint8)
        words[:, 1:] = data[starts[first[at]][:, None] + np.arange(n)]
        groups.append((at, words))
    long = [(k, np.append(np.uint8(1), data[starts[first[k]] : starts[first[k]] + size[k]])) for k in np.flatnonzero(size > LONGEST).tolist()]
    return groups, long, inverse, row_ids(bounds), first.size


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _scaled(counts: np.ndarray, pieces: Pieces, prior: float) -> np.ndarray:
    p = counts + prior
    return p / p.sum(0) * (SCALE ** np.array([len(t) for t in pieces.texts]))[:, None]


def held_out(doc_id: str = "doc_id", modulus: int = 3, remainder: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_texts(docs: DataFrame, max_train_docs: int | None = None, text: str = "text", lang: str = "lang") -> tuple[list[str], DataFrame | None]:
    """The languages, sorted, and text and k (the language's number) of the texts to learn from. All distinct labelled texts; with ``max_train_docs``, a sample that follows their hashes."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text), F.lit(8)).alias("h"))
    counts = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count_distinct("h").alias("n"), F.min("h").alias("least")).collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return [], None
    number = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("int").alias("k")
    if max_train_docs is None:
        return languages, labelled.dropDuplicates(["lang", "h"]).select("text", number)
    each = max(1, max_train_docs // len(languages))
    of = lambda value: F.try_element_at(F.create_map(*(x for name, r in counts.items() for x in (F.lit(name), F.lit(value(r))))), F.col("lang"))
    drawn = (F.pmod("h", F.lit(1_000_000)) < of(lambda r: min(1.0, each / r["n"])) * 1_000_000) | (F.col("h") == of(lambda r: r["least"]))
    sample = labelled.where(drawn).dropDuplicates(["lang", "h"]).select("text", number)
    return languages, sample


def word_counts(sample: DataFrame, n_languages: int) -> DataFrame:
    """word (its bytes) and n0, n1, ...: how often each distinct word occurs in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            groups, long, inverse, rows, n = distinct_words(*text_buffer(batch.column(0)))
            k = batch.column(1).to_numpy(zero_copy_only=False)
            counts = np.bincount(inverse * n_languages + k[rows], minlength=n * n_languages).reshape(n, -1)
            words = [b""] * n
            for at, table in groups:
                for i, word in zip(at.tolist(), table[:, 1:], strict=True):
                    words[i] = word.tobytes()
            for i, word in long:
                words[i] = word[1:].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *map(pa.array, counts.T.astype(np.int64))], names)

    names = ["word", *(f"n{k}" for k in range(n_languages))]
    schema = ", ".join(f"{c} {'binary' if c == 'word' else 'long'}" for c in names)
    return sample.mapInArrow(count, schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in names[1:]))


def learn(docs: DataFrame, vocabulary: str | None = None, max_train_docs: int | None = None, rounds: int = 3, prior: float = 0.01, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the scaled piece probabilities."""
    vocabulary = vocabulary or default_vocabulary()
    pieces = _pieces(vocabulary)
    languages, sample = training_texts(docs, max_train_docs, text, lang)
    if sample is None:
        return [], np.zeros((len(pieces.texts), 0))
    counted = materialize(word_counts(sample, len(languages)), "words")
    # tasks of about 20,000 distinct words
    counted = counted.repartition(max(16, counted.count() // 20_000))
    table = _scaled(np.ones((len(pieces.texts), len(languages))), pieces, prior)
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, total = _pieces(vocabulary), np.zeros_like(shared.value)
            for batch in by_bytes(batches, "word", LATTICE):
                data, offsets = text_buffer(batch.column(0))
                weights = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1).astype(float)
                size = np.diff(offsets)
                short = np.flatnonzero(size <= LONGEST)
                if short.size:
                    _add_expected(data, offsets[short], size[short], weights[short], pieces, shared.value, total)
                for i in np.flatnonzero(size > LONGEST).tolist():
                    long_word(np.append(np.uint8(1), data[offsets[i] : offsets[i + 1]]), pieces, shared.value, weights[i], total)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["piece", "n"])

        sums = counted.mapInArrow(count, "piece long, n array<double>").groupBy("piece").agg(*(F.sum(F.get("n", k)).alias(f"n{k}") for k in range(len(languages)))).toArrow()
        counts_now = np.zeros((len(pieces.texts), len(languages)))
        for k in range(len(languages)):
            counts_now[sums.column("piece").to_numpy(), k] = sums.column(f"n{k}").to_numpy()
        table = _scaled(counts_now, pieces, prior)
    return languages, table


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and after them lang_pred, lang_score and lang_fit: the log-likelihood a character of the text's words in that language (null without words)."""
    vocabulary = vocabulary or default_vocabulary()
    if not languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_fit": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(None).cast("double").alias("lang_fit")).schema
    place = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        known, values = np.zeros(0, _U), np.zeros((0, len(languages) + 2))
        for batch in by_bytes(batches, text, 4 << 20):
            data, offsets = text_buffer(batch.column(place))
            starts, lengths, hashes, bounds = scan_words(data, offsets, fold=False)
            names, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            rows, at = row_ids(bounds), np.minimum(np.searchsorted(known, names), max(known.size - 1, 0))
            new = np.flatnonzero(known[at] != names) if known.size else np.arange(names.size)
            fresh = np.zeros((new.size, len(languages) + 2))  # the score in each language, bytes and characters with the mark of the start
            begin, length = starts[first[new]], lengths[first[new]]
            heads = np.concatenate([[0], np.cumsum((data[offsets[0] : offsets[-1]] & 0xC0) != 0x80)])
            fresh[:, -2], fresh[:, -1] = length + 1, heads[begin + length - offsets[0]] - heads[begin - offsets[0]] + 1
            short = np.flatnonzero(length <= LONGEST)
            for part in np.array_split(short, -(-int(length[short].sum() + short.size) // LATTICE)) if short.size else ():
                graph = Lattice(data, begin[part], length[part], pieces)
                last = graph.last()
                for k in range(len(languages)):
                    fresh[part, k] = np.log(np.maximum(graph.ahead(shared.value[graph.piece, k])[last], 1e-300))
            for i in np.flatnonzero(length > LONGEST).tolist():
                fresh[i, :-2] = long_word(np.append(np.uint8(1), data[begin[i] : begin[i] + length[i]]), pieces, shared.value)
            # words of earlier batches aren't scored again
            found = np.zeros((names.size, fresh.shape[1]))
            found[new] = fresh
            if known.size:
                old = np.flatnonzero(known[at] == names)
                found[old] = values[at[old]]
            if known.size + new.size > KNOWN:
                known, values = names[:KNOWN], found[:KNOWN]
            else:
                where = np.searchsorted(known, names[new])
                known, values = np.insert(known, where, names[new]), np.insert(values, where, fresh, 0)
            score, size, chars = found[:, :-2], found[:, -2], found[:, -1]
            whole = np.stack([np.bincount(rows, score[inverse, k], batch.num_rows) for k in range(len(languages))], 1)
            sizes = np.bincount(rows, size[inverse], batch.num_rows)
            fit = (whole.max(1) - sizes * np.log(SCALE)) / np.maximum(np.bincount(rows, chars[inverse], batch.num_rows), 1)
            whole -= whole.max(1, keepdims=True)
            chance = np.exp(whole)
            chance /= chance.sum(1, keepdims=True)
            best = chance.argmax(1)
            raw, local = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            ascii_letters = (raw | 0x20) - 97 < 26
            letter = any_in_rows(ascii_letters, local)
            maybe = any_in_rows(raw >= 0x80, local)
            for i in np.flatnonzero(maybe & ~letter).tolist():
                letter[i] = any(c.isalpha() for c in raw[local[i] : local[i + 1]].tobytes().decode("utf-8", "replace"))
            named = [languages[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            posterior = np.where(letter, chance[np.arange(best.size), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named), pa.array(posterior), pa.array(fit, mask=sizes == 0)], [*batch.schema.names, "lang_pred", "lang_score", "lang_fit"])

    return docs.mapInArrow(predict, schema)


def least_fits(found: DataFrame, share: float = 0.01) -> dict[str, float]:
    """For each language the fit below which a text isn't taken to be in it: as far below the ``share`` quantile of its training texts as that is below their median.

    ``found``: lang, h (the text's hash), lang_pred and lang_fit of all training rows; each distinct text of a language counts once.
    """
    rows = found.where("lang_pred <> 'und'").select("lang", "h", "lang_pred", "lang_fit").dropDuplicates(["lang", "h"])
    fits = quantiles(rows, ["lang_pred"], "lang_fit", [share, 0.5]).collect()  # a row a language
    return {r["lang_pred"]: 2 * r["q"][0] - r["q"][1] for r in fits}


def keep_identified(docs: DataFrame, least: float = 0.5, share: float = 0.01, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The documents whose language is found, with all their columns: with at least that posterior, and a fit that texts of the language have.

    The posterior compares languages that were learned; the fit (see ``least_fits``) tells texts in none of them. Texts without a letter go.
    """
    learned = docs.where(~held_out(doc_id)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages, table = learn(learned, **options)
    rows = docs.select(F.col(f"`{text}`").alias("__text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    # texts are identified once, for the limits and for the result
    found = materialize(identify(rows, languages, table, text="__text").drop("__text"), "identified")
    own = lambda c: F.col(f"__row.`{c}`")
    taught = found.where(own(lang).isNotNull() & own(text).isNotNull()).withColumn("__id", own(doc_id)).where(~held_out("__id"))
    fits = least_fits(taught.select(own(lang).cast("string").alias("lang"), F.xxhash64(own(text), F.lit(8)).alias("h"), "lang_pred", "lang_fit"), share) if languages else {}
    fit = F.try_element_at(F.create_map(*(x for name, low in fits.items() for x in (F.lit(name), F.lit(low)))), F.col("lang_pred")) if fits else F.lit(None)
    good = (F.col("lang_pred") != "und") & (F.col("lang_score") >= least) & (F.coalesce(F.col("lang_fit"), F.lit(0.0)) >= F.coalesce(fit, F.lit(float("-inf"))))
    return found.where(good).select(*(F.col(f"__row.`{c}`") for c in docs.columns))

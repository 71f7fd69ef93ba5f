"""Language-model scores by prediction by partial matching.

Every byte of a text as it stands, white space included, and the text's end are coding steps.
The contexts of a step are the ``ORDER`` symbols before it and all their shorter endings, down
to the empty one; they cross word borders, and before the text's first byte lie start symbols.
A symbol unseen in its longest context that training has seen escapes to the next shorter one
(escape method D: half a count of every different symbol seen there), where the symbols seen in
the longer contexts are excluded; below the empty context all remaining symbols are equally
likely.

Counts are exact and have no cap: a context and its symbol are ``ORDER + 1`` digits of
``BITS`` bits in one long, a gram.  The grams and their training counts are a Spark table that grows with
the corpus (``gram_counts``).  What a context excludes from the next shorter one depends on the
context alone, so the probability of a gram follows from that of its ending by one join a
length (``coded``): no key there has more than ``SYMBOLS`` rows, and nothing goes through the
driver.  The log probabilities return to chunks of documents by a join on (chunk, gram).
Chunks hold about ``CHUNK_BYTES`` of text whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ludex.functions.batches import pieces

from .common import crc_bucket, parts, stored, texts

ORDER = 5
TEXT_END, START = 256, 257
#: What can be coded: the bytes and the text's end.
SYMBOLS = 257
#: Bits of a symbol in a gram.
BITS = 9
#: Escape method D: every symbol seen in a context gives this much of its count to the escape.
DISCOUNT = 0.5
#: Coding steps handled at once.
BLOCK = 1 << 19
#: What is left of a long beside a gram: a count of up to so much is held with it.
FREE = 63 - BITS * (ORDER + 1)
MOST = (1 << FREE) - 1
#: Text bytes of a chunk of documents.
CHUNK_BYTES = 3 << 23
#: Text bytes split into words at once.
WORD_BYTES = 1 << 21


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then the end of the text (an empty token)."""
    out = text.lower().split()
    out.append(b"")
    return out


def grams(given: list[bytes], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sizes, grams) blocks: the steps of the texts in order, ``sizes`` of them for each
    of ``rows``.  A text of more steps than a block (at least ORDER)
    goes on in the next one."""
    def made(pieces):
        rows, first, last, parts_ = zip(*pieces)
        width = np.fromiter(map(len, parts_), np.int64, len(parts_))
        at = np.cumsum(width) - width
        symbol = np.frombuffer(b"".join(parts_), np.uint8).astype(np.int64)
        ahead = at[:, None] + np.arange(ORDER)
        symbol[ahead[np.array(first)].ravel()] = START
        symbol[(at + width - 1)[np.array(last)]] = TEXT_END
        gram = symbol.copy()
        for k in range(1, ORDER + 1):
            gram[k:] |= symbol[:-k] << (BITS * k)
        own = np.ones(len(symbol), bool)
        own[ahead.ravel()] = False
        return np.array(rows), width - ORDER, gram[own]

    pieces, held = [], 0
    for i, t in enumerate(given):
        for s in range(0, len(t) + 1, block):
            last = s + block > len(t)
            ahead = bytes(ORDER) if s == 0 else t[s - ORDER:s]
            pieces.append((i, s == 0, last, ahead + t[s:s + block] + b"\0" * last))
            held += len(pieces[-1][3])
            if held >= block:
                yield made(pieces)
                pieces, held = [], 0
    if pieces:
        yield made(pieces)


@dataclass
class Events:
    """The coding steps of some texts: per step its text, symbol, and context in every order."""
    token: np.ndarray
    symbol: np.ndarray
    slots: list[np.ndarray]


def events(given: list[bytes]) -> Events:
    found = list(grams(given))
    gram = np.concatenate([g for _, _, g in found]) if found else np.zeros(0, np.int64)
    token = np.concatenate([np.repeat(r, n) for r, n, _ in found]) if found else np.zeros(0, np.int64)
    return Events(token, gram & ((1 << BITS) - 1), [(gram >> BITS) & ((1 << BITS * k) - 1) for k in range(ORDER + 1)])


def _key(order: int, slot: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (np.int64(order) << (BITS * (ORDER + 1))) | (slot << BITS) | symbol


def count_events(given: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of every (order, context, symbol) that the texts give, weighted."""
    e = events(given)
    weight = np.asarray(counts, np.int64)[e.token]
    keys, sums = [], []
    for k, slot in enumerate(e.slots):
        u, at = np.unique(_key(k, slot, e.symbol), return_inverse=True)
        keys.append(u)
        # float sums of counts are exact below 2^53
        sums.append(np.bincount(at, weights=weight, minlength=len(u)).astype(np.int64))
    return np.concatenate(keys), np.concatenate(sums)


class Trie:
    """The model of a few texts in memory, step by step: what ``coded`` is tested against.
    Contexts are rows of a sorted table of (order, context, symbol)."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        order = np.argsort(key)
        self.key, self.count = key[order].astype(np.int64), count[order].astype(np.float64)
        context = self.key >> BITS
        self.context, self.first = np.unique(context, return_index=True)
        self.last = np.append(self.first[1:], len(self.key))
        run = np.concatenate([[0.0], np.cumsum(self.count)])
        self.total = run[self.last] - run[self.first]

    def _at(self, key):
        if not len(self.key):
            return np.zeros(len(key))
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, self.count[i], 0.0)

    def _context(self, order, slot):
        """Row of each context, -1 where it was never seen."""
        if not len(self.context):
            return np.full(len(slot), -1)
        c = (np.int64(order) << (BITS * ORDER)) | slot
        i = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
        return np.where(self.context[i] == c, i, -1)

    def log10(self, given: list[bytes], block: int = 8192) -> np.ndarray:
        """log10 probability of each text."""
        e = events(given)
        # steps are independent; a block of them bounds the lists of excluded symbols
        cuts = range(0, len(e.symbol), block)
        logp = [self._steps(e.symbol[s:s + block], [x[s:s + block] for x in e.slots]) for s in cuts]
        return np.bincount(e.token, weights=np.concatenate(logp) if logp else None, minlength=len(given))

    def _steps(self, symbol: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each coding step."""
        n = len(symbol)
        logp, open_ = np.zeros(n), np.ones(n, bool)
        barred = np.zeros(0, np.int64)  # step * SYMBOLS + symbol, sorted: excluded symbols
        for k in range(ORDER, -1, -1):
            step = np.flatnonzero(open_)
            row = self._context(k, slots[k][step])
            step, row = step[row >= 0], row[row >= 0]
            if not len(step):
                continue
            total, kinds = self.total[row], (self.last - self.first)[row].astype(np.float64)
            excluded = np.zeros(len(step))
            if len(barred):
                lo, hi = np.searchsorted(barred, step * SYMBOLS), np.searchsorted(barred, (step + 1) * SYMBOLS)
                size = hi - lo
                who = np.repeat(np.arange(len(step)), size)
                which = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                c = self._at(_key(k, slots[k][step[who]], barred[which] % SYMBOLS))
                total = total - np.bincount(who, weights=c, minlength=len(step))
                kinds = kinds - np.bincount(who, weights=c > 0, minlength=len(step))
                excluded = size.astype(np.float64)
            count = self._at(_key(k, slots[k][step], symbol[step]))
            hit = count > 0
            # no escape is needed where every symbol is seen or excluded
            off = np.where(excluded + kinds >= SYMBOLS, 0.0, DISCOUNT)
            logp[step[hit]] += np.log10((count[hit] - off[hit]) / total[hit])
            open_[step[hit]] = False
            miss = ~hit & (kinds > 0)
            logp[step[miss]] += np.log10(off[miss] * kinds[miss] / total[miss])
            step, row = step[~hit], row[~hit]
            size = self.last[row] - self.first[row]
            which = np.repeat(self.first[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            seen = np.repeat(step, size) * SYMBOLS + (self.key[which] & ((1 << BITS) - 1))
            barred = np.union1d(barred, seen)
        step = np.flatnonzero(open_)
        if len(step):
            size = np.searchsorted(barred, (step + 1) * SYMBOLS) - np.searchsorted(barred, step * SYMBOLS)
            logp[step] -= np.log10(SYMBOLS - size)
        return logp


def words_of(column) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The words of ``tokens``, without the ends, of a column of texts, split and numbered by Arrow.

    A few MB of texts at a time: their distinct words, the place among them of each word, and its text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begins = np.unique(np.searchsorted(size // WORD_BYTES, np.arange(size[-1] // WORD_BYTES + 1))) if len(size) else []
    for i, j in zip(begins, [*begins[1:], len(column)]):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(i, j - i), "")))
        flat, row = lists.flatten(), pc.list_parent_indices(lists)
        some = pc.not_equal(pc.binary_length(flat), 0)  # what lies before a leading space
        found = flat.filter(some).dictionary_encode()
        yield found.dictionary.cast(pa.binary()), found.indices.to_numpy(), row.filter(some).to_numpy() + i


#: The end of a text, as a token.
_END = pa.array([b""], pa.binary())


def token_counts(docs: DataFrame) -> DataFrame:
    """docs (train boolean, t) -> (token, c): every token of any text and its number in the
    training texts.  Tasks add up before the shuffle."""
    def run(batches):
        pa.default_memory_pool().release_unused()
        for b in batches:
            train = np.array(b.column("train").to_pylist(), bool)
            words, counts = [_END], [np.array([train.sum()])]
            for some, at, text in words_of(b.column("t")):
                words.append(some)
                counts.append(np.bincount(at[train[text]], minlength=len(some)))
            every = pa.concat_arrays(words).dictionary_encode()
            c = np.bincount(every.indices.to_numpy(), np.concatenate(counts), len(every.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([every.dictionary, pa.array(c)], names=["token", "c"])

    return docs.mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Places in a sorted array where a new value begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_firsts(x)]


def packed(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A gram and its count as one long; a count beyond ``MOST`` takes several."""
    whole, rest = np.divmod(count, MOST)
    one = gram << FREE | rest
    return np.concatenate([one, np.repeat(gram << FREE | MOST, whole)]) if whole.any() else one


def added(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each gram of ``packed`` ones once, sorted, with the sum of its counts; empties ``held``.

    They are sorted in place, so little is held beside one copy."""
    one = np.concatenate(held)
    held.clear()
    one.sort()
    first = _firsts(one >> FREE)
    gram = one[first] >> FREE
    one &= MOST
    return gram, np.add.reduceat(one, first) if len(first) else one


def distinct(blocks: Iterator[np.ndarray], flush: int = 1 << 21) -> np.ndarray:
    """The different grams of the blocks, sorted.  They are merged whenever as many as before came in, and ``flush``."""
    held, size, merged = [], 0, 0
    for b in blocks:
        held.append(_distinct(b))
        size += len(held[-1])
        if size >= 2 * merged + flush:
            held = [_merged(held)]
            size = merged = len(held[0])
    return _merged(held) if held else np.zeros(0, np.int64)


def _merged(held: list[np.ndarray]) -> np.ndarray:
    """The different values of the arrays, sorted in place; empties ``held``."""
    one = np.concatenate(held)
    held.clear()
    one.sort()
    return one[_firsts(one)]


def steps_of(rows, some: int = 512, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``grams`` of the texts (t) of a table or batch, ``some`` texts of about two blocks of bytes
    at a time, or a longer one: few bytes are held beside it."""
    for i, j in pieces(rows.column("t"), some, 2 * block):
        for row, sizes, gram in grams(texts(rows.slice(i, j - i), "t"), block):
            yield row + i, sizes, gram


def gram_counts(docs: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """docs (train boolean, t) -> (gram, c): every gram of any text and its number in the
    training texts.  Tasks add up before the shuffle."""
    def run(batches):
        held, size = [], 0
        pa.default_memory_pool().release_unused()
        for b in batches:
            train = np.array(b.column("train").to_pylist(), bool)
            for rows, sizes, gram in steps_of(b):
                # grams and whether they train, sorted as one number
                one = gram << 1 | np.repeat(train[rows], sizes)
                one.sort()
                first = _firsts(one >> 1)
                held.append(packed(one[first] >> 1, np.add.reduceat(one & 1, first)))
                size += len(held[-1])
                if size >= flush:
                    g, c = added(held)
                    if 2 * len(g) >= flush:
                        size = 0
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["gram", "c"])
                    else:
                        held.append(packed(g, c))
                        size = len(held[0])
                    del g, c
        if held:
            g, c = added(held)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["gram", "c"])

    return docs.mapInArrow(run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def coded(counted: DataFrame) -> DataFrame:
    """(gram, c) -> (gram, logp): log10 probability of each gram's symbol after its context.

    Per length, from the empty context up, a row is a context and a symbol that follows it in
    any text: ``n`` its training count, ``total`` and ``kinds`` the context's counts and
    different symbols, ``p`` the log probability of a step that begins at this context, ``r``
    (used where n = 0) of one that has escaped from it.
    """
    def off(kinds):
        # no escape is needed where every symbol is seen
        return F.when(kinds >= SYMBOLS, F.lit(0.0)).otherwise(F.lit(DISCOUNT))

    n, total, kinds, un, ut, uk, ex = map(F.col, ("n", "total", "kinds", "un", "ut", "uk", "ex"))
    own = Window.partitionBy(F.shiftright("gram", BITS))
    below = None
    for k in range(ORDER + 1):
        gram = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("gram")
        rows = counted.groupBy(gram).agg(F.sum("c").cast("double").alias("n")) if k < ORDER else counted.select("gram", F.col("c").cast("double").alias("n"))
        stats = [F.sum("n").over(own).alias("total"), F.sum((n > 0).cast("double")).over(own).alias("kinds")]
        if below is None:
            rows = rows.select("gram", "n", *stats)
            left, unseen = -F.log10(F.lit(float(SYMBOLS)) - kinds), F.lit(-math.log10(SYMBOLS))
        else:
            up = below.select(F.col("gram").alias("ug"), n.alias("un"), total.alias("ut"), kinds.alias("uk"), F.col("p").alias("up"), F.col("r").alias("ur"))
            rows = (rows.join(up, F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)) == F.col("ug"))
                    .select("gram", "n", "un", "ut", "uk", "up", "ur", *stats, F.sum(F.when(n > 0, un).otherwise(0.0)).over(own).alias("ex")))
            escape = F.when(uk > kinds, F.log10(off(uk) * (uk - kinds)) - F.log10(ut - ex)).otherwise(0.0)
            left, unseen = F.when(un > 0, F.log10(un - off(uk)) - F.log10(ut - ex)).otherwise(escape + F.col("ur")), F.col("up")
        begun = (F.when(n > 0, F.log10(n - off(kinds)) - F.log10(total))
                 .when(total > 0, F.log10(off(kinds) * kinds) - F.log10(total) + F.col("r")).otherwise(unseen))
        below = rows.withColumn("r", left).withColumn("p", begun).select("gram", "n", "total", "kinds", "p", "r")
    return below.select("gram", F.col("p").alias("logp"))


def summed(steps: np.ndarray, sizes: np.ndarray, gram: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The sum of the steps' ``logp`` for each text of ``sizes`` steps; ``gram`` is sorted.

    Steps are sorted as one number with their text, so that each gram is looked up once, in order."""
    out = np.zeros(len(sizes))
    bits = 63 - BITS * (ORDER + 1)
    ends, most = np.cumsum(sizes), 1 << bits
    for at in range(0, len(sizes), most):
        first, last = ends[at] - sizes[at], ends[min(at + most, len(sizes)) - 1]
        one = np.sort(steps[first:last] << bits | np.repeat(np.arange(len(sizes[at:at + most])), sizes[at:at + most]))
        found, text = one >> bits, one & (most - 1)
        begins = _firsts(found)
        i = np.minimum(np.searchsorted(gram, found[begins]), len(gram) - 1)
        if not (gram[i] == found[begins]).all():
            raise ValueError("grams of a chunk are missing: the input changed between two reads")
        known = np.repeat(logp[i].astype(np.float64), np.diff(np.r_[begins, len(one)]))
        out[at:at + most] = np.bincount(text, known, len(sizes[at:at + most]))
    return out


def dealt(given: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Adds ``chunk``: rows are dealt one by one to as many chunks as the texts (t) fill, so a
    chunk has about ``chunk_bytes`` whatever the corpus, and copies of a row spread."""
    size = given.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long") + 1).alias("n")).first()["n"] or 0
    return given.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(size // chunk_bytes + 1)))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32 of the key as text, modulo ``modulus``, isn't ``held`` train the model.
    ``base_score``: the unigram model's log10 probability with one added to every count, of the
    lower-cased words and the end; ``score``: that of every byte and the end.

    Null texts are empty (the end alone); null keys count as the empty text's crc32; repeated
    rows train and are scored each.  Without training rows the trie is empty and all symbols
    equally likely.  Other columns aren't read.  An empty table gives an empty result.
    """
    n = parts(docs.sparkSession)
    given = docs.select(F.col(key).alias("k"), (crc_bucket(key, modulus) == held).alias("held_out"), F.col(text).alias("t"))
    training = given.select((~F.col("held_out")).alias("train"), "t")
    counted = stored(token_counts(training), "lm-tokens")
    total = counted.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    all_tokens, kinds = total["n"] or 0, total["v"] or 0
    scored = coded(stored(gram_counts(training), "lm-grams"))
    # all readers of the chunks share one shuffle of the texts
    chunked = dealt(given).repartition(n, "chunk")

    def tokens_of(rows: pa.Table) -> pa.Table:
        words = pc.unique(pa.concat_arrays([_END, *[some for some, _, _ in words_of(rows.column("t"))]]))
        return pa.table([pa.array(np.full(len(words), rows.column("chunk")[0].as_py())), words], names=["chunk", "token"])

    def grams_of(rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        found = distinct(gram for _, _, gram in steps_of(rows, block=BLOCK // 2))
        return pa.table([pa.array(np.full(len(found), rows.column("chunk")[0].as_py())), pa.array(found)], names=["chunk", "gram"])

    groups = chunked.groupBy("chunk")
    known_tokens = groups.applyInArrow(tokens_of, "chunk bigint, token binary").join(counted, "token").select("chunk", "token", F.col("c").alias("n"), F.lit(None).cast("float").alias("logp"))
    known_grams = groups.applyInArrow(grams_of, "chunk bigint, gram bigint").join(scored, "gram").select("chunk", F.lit(None).cast("binary").alias("token"), F.col("gram").alias("n"), F.col("logp").cast("float"))
    # n is a token's training count, or a gram; a step's logp travels in single precision, sums are double
    wanted = known_tokens.unionByName(known_grams)
    floor = float(all_tokens + kinds + 1)

    def add_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # a worker keeps what earlier stages took
        gram, logp = known.column("n").to_numpy(), known.column("logp").to_numpy()
        spelled = pc.is_valid(known.column("token")).to_numpy()
        c, spelled_ = gram[spelled], pc.drop_null(known.column("token")).combine_chunks()
        gram, logp = gram[~spelled], logp[~spelled]
        del known, spelled
        order = np.argsort(gram)
        gram, logp = gram[order], logp[order]
        del order
        n = rows.num_rows
        end = c[pc.index_in(_END, value_set=spelled_)[0].as_py()]
        n_tokens, n_known, base = np.ones(n, np.int64), np.full(n, int(end > 0)), np.full(n, np.log10((end + 1) / floor))
        for words, at, text in words_of(rows.column("t")):
            of = c[pc.index_in(words, value_set=spelled_).to_numpy()]
            n_tokens += np.bincount(text, minlength=n)
            n_known += np.bincount(text, (of > 0)[at], n).astype(np.int64)
            base += np.bincount(text, np.log10((of + 1) / floor)[at], n)
        scores = np.zeros(n)
        for row, sizes, found in steps_of(rows, block=BLOCK // 2):
            np.add.at(scores, row, summed(found, sizes, gram, logp))
        return pa.table([rows.column("k"), rows.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(scores)],
                        names=["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    done = (groups.cogroup(wanted.groupBy("chunk"))
            .applyInArrow(add_up, f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))
    return done.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"),
                       "base_score", "score")

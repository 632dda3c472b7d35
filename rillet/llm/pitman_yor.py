"""Language-model scoring with a hierarchical Pitman-Yor model over words and their bytes.

A text is its lower-cased words, each closed by a space, then one end. The words of a text so
far sit in its own restaurant; all texts' restaurants share one parent, with the training
words as customers. The parent of that spells words, seen or
not, symbol by symbol, with the context of the words before. Every symbol has a restaurant for its context of up to ``ORDER - 1`` symbols; a context's parent restaurant
drops the symbol furthest back, and the last parent is uniform. Seating (Chinese-restaurant
process with discount and strength) is sampled in all of them. A text's words sit down one after
the other, each where the process puts it given the words before. The training words and the
symbols are sampled by Gibbs in blocks: a sweep seats every customer
of every dish anew, a table is a customer in the parent restaurant. Only numbers of tables
matter to the probabilities, so a dish's customers are moved together: given its context's
mass (a gamma variable, which makes the dishes independent), its number of tables is drawn
from the weights of all seatings, whatever the number of customers. A table is a customer of its
dish in the parent restaurant, so these weights hold the parent's seating too: given the shares
of the parent's dishes (Dirichlet, from its customers and tables), the dishes of the children are
drawn and kept or not, for each dish of the parent, by what the parent's seatings at its tables
then weigh. Predictive probabilities are averaged over the samples after burn-in.

On Spark:
1. one scan counts the words and the symbol n-grams of the training documents (n-grams of the
   others are listed with count 0), combined in each task before the shuffle;
2. restaurants are grouped by the last two context symbols, so that a group holds whole subtrees
   and is sampled by itself; the restaurants above (one context symbol or none, at most
   256 x 256 dishes) are sampled on the driver from the groups' summed tables, alternating. The
   groups are independent given the measures of order 2, so these are drawn, not averaged, for
   the groups to sample under; what is averaged is predicted from the seating of all levels;
3. one scan draws an occurrence of each training word, in whose context its tables are spelled;
   its n-grams get their probabilities by a join. The words' tables are sampled in tasks, sweep by
   sweep; the driver draws the restaurant's mass from their sum;
4. documents are dealt into blocks of bounded size by a hash. A block asks for the words and
   n-grams that it holds, gets their counts, tables and probabilities by a join, and seats and
   scores its documents in a cogroup. Nothing of the size of the vocabulary is broadcast.

Defined cases: null or empty text is the end alone; null ids count as training documents;
repeated rows are scored each; without training documents every symbol is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.staging import staged
from rillet.llm.words import Words, bytes_of, mix, pieces

ORDER = 5
#: Symbols: bytes; two that UTF-8 never uses close a text and stand before it.
END, BEFORE, SPACE = 0xFF, 0xFE, 0x20
SYMBOLS = 256
#: Discount and strength of the word restaurant, and of the symbols' by order (index 0: order 1).
WORD_DISCOUNT, WORD_STRENGTH = 0.8, 1.0
TEXT_DISCOUNT, TEXT_STRENGTH = 0.9, 300.0
DISCOUNT = (0.5, 0.6, 0.7, 0.75, 0.8)
STRENGTH = (1.0, 1.0, 1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 4, 4
#: Up to so many customers the number of tables is drawn from all its values, beyond by so many
#: Metropolis steps; up to the second bound the seatings are counted by recursion.
LISTED, MOVES, COUNTED = 32, 3, 256
#: Share of Metropolis steps that propose any number of tables.
ANY = 0.1
#: A sweep draws the children of a parent's dish in so many random parts, each kept or not.
PARTS = 2
#: Sampling starts with this times customers^discount tables of a dish.
START = 0.5
BLOCK_BYTES = 12 << 20
#: Text that a task has in numpy at once (about 100 bytes of memory for each byte).
PIECE_BYTES = 1 << 20
#: Keys that a task combines before it sends them on.
COMBINE = 1_500_000

END_TOKEN = np.int64(-1)
_TOP = np.uint64(1 << 63)
#: Scrambles contexts, and back.
MIXER = np.uint32(0x9E3779B1)
UNMIXER = np.uint32(pow(0x9E3779B1, -1, 1 << 32))
#: Words of which a task looks up the spellings, and whose tables it draws at once.
BLOCK_WORDS = 1 << 18


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram of each symbol, key of each token, symbols by token, tokens by text).

    Tokens are a text's words and its end. They have negative keys, n-grams (``ORDER`` bytes)
    positive ones.
    """
    data, offset = bytes_of(texts)
    n = len(offset) - 1
    # Every text gets room for the symbols before it, for a space and for its end.
    first = offset[:-1] + (ORDER + 1) * np.arange(n)
    last = offset[1:] + (ORDER + 1) * np.arange(1, n + 1) - 1
    before = (first[:, None] + np.arange(ORDER - 1)).ravel()
    own = np.ones(len(data) + (ORDER + 1) * n, bool)
    own[before] = own[last - 1] = own[last] = False
    word = (data != SPACE) & (data - np.uint8(0x09) > 0x0D - 0x09)
    lower = data + ((data - np.uint8(65) < 26).view(np.uint8) << 5)
    symbol = np.full(len(own), SPACE, np.uint8)
    symbol[own] = np.where(word, lower, np.uint8(SPACE))
    symbol[before], symbol[last] = BEFORE, END
    inside, closes = np.zeros((2, len(own)), bool)
    inside[own] = word
    closes[1:] = inside[:-1] & ~inside[1:]
    closes[last] = True
    kept = inside | closes
    kept[before] = True

    flat = np.zeros(8 - ORDER + np.count_nonzero(kept), np.uint8)  # after so many symbols of no text
    flat[8 - ORDER :] = symbol[kept]
    wide = np.ndarray(max(len(flat) - 7, 0), ">i8", flat, 0, (1,)).astype(np.int64)  # each symbol and the 7 before it
    end = np.flatnonzero(closes[kept]) - (ORDER - 1)  # last symbols of tokens, as places in ``wide``
    ends = np.searchsorted(np.flatnonzero(closes), last)
    n_tokens = np.diff(ends, prepend=-1)
    sizes = np.diff(end, prepend=-ORDER)
    sizes[ends - n_tokens + 1] -= ORDER - 1
    real = np.ones(len(wide), bool)
    real[(end[ends[:-1], None] + np.arange(1, ORDER)).ravel()] = False
    grams = wide[real]
    grams &= (1 << 8 * ORDER) - 1

    # A word of up to 8 bytes is one number (and a length).
    length = sizes - 1
    spare = 8 * (8 - np.clip(length, 1, 8))
    hashes = mix(wide[end - 1].view(np.uint64) << spare.astype(np.uint64)) + length.astype(np.uint64)
    long = np.flatnonzero(length > 8)
    stop = end[long] + 7
    hashes[long] = Words(n, flat, offset, stop - length[long], stop, n_tokens).hashes()
    keys = (hashes | _TOP).view(np.int64)
    keys[ends] = END_TOKEN
    return grams, keys, sizes, n_tokens


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _by_word(tokens: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each token, tokens by text, word and place, where in that order a text's word begins)."""
    n = len(tokens)
    text = np.repeat(np.arange(len(n_tokens)), n_tokens)
    distinct, code = np.unique(tokens, return_inverse=True)
    # Text, token and place as one number: below 2^63 for any piece that fits in memory.
    pair, order = np.divmod(np.sort((text * len(distinct) + code) * n + np.arange(n)), max(n, 1))
    fresh = np.ones(n, bool)
    fresh[1:] = pair[1:] != pair[:-1]
    return text, order, np.flatnonzero(fresh)


def _earlier(order: np.ndarray, start: np.ndarray) -> np.ndarray:
    n = len(order)
    earlier = np.empty(n, np.int64)
    earlier[order] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    return earlier


def _since(opens: np.ndarray, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many of a text's tokens before each one open a table."""
    tables = np.cumsum(opens)
    return tables - opens - (tables - opens)[first][text]


def history(tokens: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: how many stand before it in its text, how many of these are equal, and distinct."""
    text, order, start = _by_word(tokens, n_tokens)
    first = np.cumsum(n_tokens) - n_tokens
    earlier = _earlier(order, start)
    return np.arange(len(tokens)) - first[text], earlier, _since(earlier == 0, first, text)


def chance_of(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for a word at a place of its text: equal texts are seated in the same way."""
    return (mix(tokens.view(np.uint64) + mix(at.astype(np.uint64))) >> np.uint64(11)) * 2.0**-53


def seat(tokens: np.ndarray, n_tokens: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's tokens sit down one after the other: of each, how many stand before it in its
    text, how many of these are equal, and the tables of its word and of all words then.

    ``parent``: the tokens' probabilities in the parent. A token opens a table as the process has
    it, by the chance of its place. All are seated at once, given the tables that the last round
    left before them, until none changes: then each has what one after the other would give.
    """
    text, order, start = _by_word(tokens, n_tokens)
    first = np.cumsum(n_tokens) - n_tokens
    at, earlier = np.arange(len(tokens)) - first[text], _earlier(order, start)
    opens = earlier == 0
    again = order[np.flatnonzero(~opens[order])]  # tokens whose word has come before, a word's together
    begin = np.flatnonzero(earlier[again] == 1)
    word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(again))))
    chance, p, before = chance_of(tokens[again], at[again]), parent[again], earlier[again]
    own = np.ones(len(again), np.int64)
    all_ = _since(opens, first, text)
    while len(again):
        new = (TEXT_STRENGTH + TEXT_DISCOUNT * all_[again]) * p
        sits = chance * (before - TEXT_DISCOUNT * own + new) < new
        if np.array_equal(sits, opens[again]):
            break
        opens[again] = sits
        tables = np.cumsum(sits) - sits
        own = 1 + tables - tables[begin][word]
        all_ = _since(opens, first, text)
    of_word = np.minimum(earlier, 1)
    of_word[again] = own
    return at, earlier, of_word, all_


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]])]


class Values:
    """Values of keys (0 for others): the keys in the order of their hashes, entered by the hashes' first bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashes = mix(keys.view(np.uint64))
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], ~np.uint64(0))
        self.values = [np.append(v[order], 0.0) for v in values]
        bits = max(len(keys).bit_length(), 1)
        self.spare = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.spare)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The first values."""
        return self.all(keys)[0]

    def all(self, keys: np.ndarray) -> list[np.ndarray]:
        wanted = mix(keys.view(np.uint64))
        at = self.first[wanted >> self.spare]
        found = self.hashes[at]
        low = np.flatnonzero(found < wanted)
        while len(low):
            at[low] += 1
            found[low] = self.hashes[at[low]]
            low = low[found[low] < wanted[low]]
        return [np.where(found == wanted, v[at], 0.0) for v in self.values]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(count, start)


def _scrambled(context: np.ndarray) -> np.ndarray:
    """Contexts of four symbols as other numbers of 32 bits, in no order that means anything."""
    x = context.astype(np.uint32) * MIXER
    return (x ^ (x >> np.uint32(16))) * MIXER


def _context(scrambled: np.ndarray) -> np.ndarray:
    x = scrambled.astype(np.uint32) * UNMIXER
    return (x ^ (x >> np.uint32(16))) * UNMIXER


def _rows_of(values: np.ndarray, sizes: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The chosen ones of rows of so many values each."""
    kept = sizes[take]
    return values[np.arange(kept.sum()) + np.repeat((np.cumsum(sizes) - sizes)[take] - (np.cumsum(kept) - kept), kept)]


def _words(keys: np.ndarray, n: np.ndarray, drawn: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same by distinct key: n summed, and the spelling of the least drawn number."""
    order = np.lexsort((drawn, keys))
    start = np.flatnonzero(np.concatenate([np.ones(min(len(order), 1), bool), keys[order][1:] != keys[order][:-1]]))
    take = order[start]
    total = np.add.reduceat(n[order], start) if len(start) else n
    return keys[take], total, drawn[take], sizes[take], _rows_of(symbols, sizes, take)


def counts(docs: DataFrame) -> DataFrame:
    """(key, n, spelling): training counts of words, the end and n-grams; n-grams of all documents are listed.

    A word's spelling is one of its occurrences: the four symbols before it (scrambled, the least
    of all), then its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        number: list[np.ndarray] = []
        words: list[tuple[np.ndarray, ...]] = []

        def out_words() -> pa.RecordBatch:
            key, n, drawn, sizes, symbols = words[0]
            offset = np.append(0, np.cumsum(sizes + 4)).astype(np.int32)
            flat = np.empty(offset[-1], np.uint8)
            head = (offset[:-1, None] + np.arange(4)).ravel()
            own = np.ones(len(flat), bool)
            own[head] = False
            flat[head], flat[own] = drawn.astype(">u4").view(np.uint8), symbols
            spelling = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offset), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), spelling], names=names)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(number[0]), pa.nulls(len(keys[0]), pa.binary())], names=names)

        for batch in pieces(batches, size=PIECE_BYTES):
            grams, tokens, sizes, n_tokens = symbols_of(batch.column("text"))
            train = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), n_tokens)
            in_train = np.repeat(train, sizes)
            key, n = np.unique(grams[in_train], return_counts=True)
            other = _distinct(grams[~in_train])
            keys += [key, other]
            number += [n, np.zeros(len(other), np.int64)]
            drawn = _scrambled(grams[np.cumsum(sizes) - sizes] >> 8)[train]
            one = np.ones(len(drawn), np.int64)
            words.append(_words(tokens[train], one, drawn, sizes[train], grams[in_train].astype(np.uint8)))
            if sum(map(len, keys)) > COMBINE:
                key, n = _summed(keys, number)
                keys, number = [key], [n]
                if len(key) > COMBINE // 2:
                    yield out()
                    keys, number = [], []
            if sum(len(x[0]) for x in words) > COMBINE:
                words[:] = [_words(*map(np.concatenate, zip(*words, strict=True)))]
                if len(words[0][0]) > COMBINE // 2:
                    yield out_words()
                    words.clear()
        if keys:
            key, n = _summed(keys, number)
            keys, number = [key], [n]
            yield out()
        if words:
            words[:] = [_words(*map(np.concatenate, zip(*words, strict=True)))]
            yield out_words()

    names = ["key", "n", "spelling"]
    rows = docs.select("text", "held_out").mapInArrow(run, "key long, n long, spelling binary")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("spelling").alias("spelling"))


def grams_of_spellings(spellings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of each symbol, symbols by word)."""
    rows = spellings.cast(pa.large_binary())
    offset = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[offset[0] : offset[-1]].copy()
    offset = offset - offset[0]
    sizes = np.diff(offset) - 4
    head = (offset[:-1, None] + np.arange(4)).ravel()
    data[head] = _context(data[head].view(">u4")).astype(">u4").view(np.uint8)
    last = np.arange(sizes.sum()) + np.repeat(offset[:-1] + 4 - (np.cumsum(sizes) - sizes), sizes)
    grams = np.zeros(len(last), np.int64)
    for i in range(ORDER):
        grams = grams << 8 | data[last - (ORDER - 1 - i)]
    return grams, sizes


def _stirling(z: np.ndarray) -> np.ndarray:
    """log gamma(z) for z >= 8."""
    w = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = x.copy()
    for i in range(1, 8):
        shift *= x + i
    return _stirling(x + 8) - np.log(shift)


@cache
def _counted(discount: float) -> np.ndarray:
    """[c, t]: log of the summed weights of all seatings of c customers at t tables."""
    out = np.full((COUNTED + 1, COUNTED + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, COUNTED):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - t * discount)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


def log_ways(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Log of the summed weights of all seatings of c customers at t tables, up to a term of c alone.

    A table of n customers weighs (1 - discount)(2 - discount)...(n - 1 - discount). Divided by
    c! / (t! discount^t), the sum is the coefficient of z^c in (1 - (1 - z)^discount)^t. Few
    customers: by recursion. Else by the expansion of that power, where its terms don't cancel
    (t up to 1.5 c^discount), and by the saddle point where there are more tables.
    """
    out = np.empty(len(c))
    few = c <= COUNTED
    out[few] = _counted(discount)[c[few], t[few]]
    many = np.flatnonzero(~few)
    if not len(many):
        return out
    c, t = c[many].astype(float), t[many].astype(float)
    u = t * c**-discount
    log = np.empty(len(c))
    low = 0.0
    for high, terms in ((0.03, 7), (0.2, 14), (1.5, 60)):
        at = np.flatnonzero((u > low) & (u <= high))
        low = high
        if not len(at):
            continue
        cc, tt = c[at], t[at]
        one, total, choose = _stirling(cc - discount), np.zeros(len(at)), np.ones(len(at))
        for j in range(1, terms + 1):
            choose = choose * np.maximum(tt - j + 1, 0) / j
            sine = np.sin(np.pi * discount * j) * math.gamma(1 + discount * j) / np.pi
            total += (-1) ** (j + 1) * sine * choose * np.exp(_stirling(cc - discount * j) - one)
        log[at] = np.log(np.maximum(total, 1e-300)) + one - _stirling(cc + 1)
    at = np.flatnonzero(u > 1.5)
    if len(at):
        cc, tt = c[at], t[at]
        lo, hi = np.full(len(at), -80.0), np.full(len(at), -1e-12)
        for _ in range(50):  # log(1 - z) at the saddle point
            y = (lo + hi) / 2
            over = np.log(tt * discount) + np.log(-np.expm1(y)) + (discount - 1) * y - np.log(-np.expm1(discount * y)) > np.log(cc)
            lo, hi = np.where(over, y, lo), np.where(over, hi, y)
        z, q = -np.expm1(y), np.exp(y)
        bend = cc * (1 + (1 - discount) * z / q - cc / tt)
        log[at] = tt * np.log(-np.expm1(discount * y)) - cc * np.log(z) - 0.5 * np.log(np.maximum(2 * np.pi * bend, 1))
    out[many] = log - _log_gamma(t + 1) - t * np.log(discount)
    return out


def log_seatings(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """``log_ways`` with the term of c, so that numbers of customers can be compared; -inf if t > c."""
    out = np.full(len(c), -np.inf)
    can = t <= c
    c, t = c[can], t[can]
    out[can] = log_ways(c, t, discount) + np.where(c > COUNTED, _log_gamma(c + 1.0), 0.0)
    return out


def tilted_stable(a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Draws with Laplace transform exp(-a ((1 + s)^discount - 1)): a sum of stable ones (Kanter) kept with e^-draw."""
    out = np.zeros(len(a))
    pieces_ = np.maximum(np.ceil(a), 1).astype(np.int64)
    at = np.repeat(np.arange(len(a)), pieces_)
    scale = (a / pieces_) ** (1 / discount)
    while len(at):
        u, e = np.pi * (1 - rng.random(len(at))), rng.standard_exponential(len(at))
        log = np.log(np.sin(discount * u)) - np.log(np.sin(u)) / discount
        draw = scale[at] * np.exp(log + (np.log(np.sin((1 - discount) * u)) - np.log(e)) * (1 / discount - 1))
        kept = rng.random(len(at)) < np.exp(-draw)
        out += np.bincount(at[kept], draw[kept], len(a))
        at = at[~kept]
    return out


def draw_tables(c: np.ndarray, t: np.ndarray, x: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish with c customers (now at t), of weight ways(c, tables) * x^tables."""
    t = np.clip(t, np.minimum(c, 1), c)
    x = np.maximum(x, 1e-290)
    table = _counted(discount)
    small = np.flatnonzero((c > 1) & (c <= LISTED))
    small = small[np.argsort(c[small], kind="stable")]
    border = np.searchsorted(c[small], np.arange(2, LISTED + 2))
    chance = rng.random(len(c))
    for n in range(2, LISTED + 1):
        at = small[border[n - 2] : border[n - 1]]
        if len(at):
            log = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(x[at])[:, None]
            weight = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (weight < chance[at][:, None] * weight[:, -1:]).sum(axis=1)
    large = np.flatnonzero(c > LISTED)
    if len(large):
        # Proposed: one and a binomial number with about the mean of the wanted distribution, or
        # sometimes any number, so that no unlikely state is kept.
        cc, xx, now = c[large], x[large], t[large]
        y = np.minimum(np.log(xx / cc) / (1 - discount), np.log(xx / (xx + cc)))
        for _ in range(6):
            q = np.exp(y)
            y = y - (np.log(xx / cc) + np.log1p(-q) + (discount - 1) * y) / (-q / (1 - q) + discount - 1)
        p = np.clip(xx / discount * -np.expm1(discount * y) / cc, 1e-300, 1 - 1e-9)
        odds, log_x = np.log(p) - np.log1p(-p), np.log(xx)
        scale = np.log(1 - ANY) + _log_gamma(cc) + cc * np.log1p(-p) - np.log(p)
        uniform = np.log(ANY / cc)

        def ratio(n: np.ndarray) -> np.ndarray:
            """Log of wanted over proposed."""
            binomial = scale + n * odds - _log_gamma(n) - _log_gamma(cc - n + 1)
            return log_ways(cc, n, discount) + n * log_x - np.logaddexp(binomial, uniform)

        was = ratio(now)
        for _ in range(MOVES):
            new = np.where(rng.random(len(now)) < ANY, rng.integers(1, cc + 1), 1 + rng.binomial(cc - 1, p))
            is_ = ratio(new)
            take = np.log(rng.random(len(now))) < is_ - was
            now, was = np.where(take, new, now), np.where(take, is_, was)
        t[large] = now
    return t


class Restaurants:
    """All restaurants of one order within a group: dishes with customers at tables, kept by dish.

    ``keys`` are the sorted n-grams (context and dish) of that order.
    """

    def __init__(self, keys: np.ndarray, order: int, rng: np.random.Generator):
        self.keys, self.rng = keys, rng
        self.discount, self.strength = DISCOUNT[order - 1], STRENGTH[order - 1]
        contexts, self.context = np.unique(keys >> 8, return_inverse=True)
        self.n_contexts = len(contexts)
        self.customers = np.zeros(len(keys), np.int64)
        self.tables = np.zeros(len(keys), np.int64)
        self.at = np.empty(0, np.int64)  # dish of each table, ascending
        self.size = np.empty(0, np.int64)

    def start(self, customers: np.ndarray) -> None:
        """Each dish's customers at one table."""
        self.customers = customers.astype(np.int64).copy()
        self.tables = (customers > 0).astype(np.int64)
        self.at = np.flatnonzero(customers)
        self.size = self.customers[self.at].copy()

    def spread(self, customers: np.ndarray) -> None:
        """Each dish's customers at about as many tables as many customers take."""
        self.customers = customers.astype(np.int64)
        many = np.rint(START * customers.astype(float) ** self.discount).astype(np.int64)
        self.tables = np.clip(many, np.minimum(self.customers, 1), self.customers)

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        """Each dish's probability, given its probability in the parent restaurant."""
        c = np.bincount(self.context, self.customers, self.n_contexts)[self.context]
        t = np.bincount(self.context, self.tables, self.n_contexts)[self.context]
        own = self.customers - self.discount * self.tables + (self.strength + self.discount * t) * parent
        return np.where(c > 0, own / (self.strength + c), parent)

    def leave(self, dishes: np.ndarray) -> np.ndarray:
        """One random customer of each of the (distinct) dishes leaves; the dishes that lost a table."""
        before = np.cumsum(self.customers) - self.customers
        chosen = before[dishes] + (self.rng.random(len(dishes)) * self.customers[dishes]).astype(np.int64)
        table = np.searchsorted(np.cumsum(self.size), chosen, side="right")
        self.size[table] -= 1
        self.customers[dishes] -= 1
        empty = table[self.size[table] == 0]
        lost = self.at[empty]
        self.tables[lost] -= 1
        keep = np.ones(len(self.size), bool)
        keep[empty] = False
        self.at, self.size = self.at[keep], self.size[keep]
        return lost

    def enter(self, dishes: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """One customer for each of the (distinct) dishes sits down; the dishes that got a table."""
        t = np.bincount(self.context, self.tables, self.n_contexts)[self.context[dishes]]
        old = np.maximum(self.customers[dishes] - self.discount * self.tables[dishes], 0)
        new = (self.strength + self.discount * t) * parent[dishes]
        opens = (self.rng.random(len(dishes)) * (old + new) >= old) | (self.tables[dishes] == 0)
        join = dishes[~opens]
        if len(join):
            weight = np.cumsum(self.size - self.discount)
            last = np.searchsorted(self.at, join, side="right") - 1
            first = np.searchsorted(self.at, join, side="left")
            low = weight[first] - (self.size[first] - self.discount)
            table = np.searchsorted(weight, low + self.rng.random(len(join)) * (weight[last] - low), side="right")
            self.size[np.clip(table, first, last)] += 1
        fresh = dishes[opens]
        place = np.searchsorted(self.at, fresh, side="right")
        self.at, self.size = np.insert(self.at, place, fresh), np.insert(self.size, place, 1)
        self.customers[dishes] += 1
        self.tables[fresh] += 1
        return fresh

    def masses(self) -> np.ndarray:
        """Of each dish's context: a gamma variable that makes its dishes' tables independent."""
        t = np.bincount(self.context, self.tables, self.n_contexts)
        return self.rng.gamma(self.strength / self.discount + t)[self.context]

    def draw(self, parent: np.ndarray) -> None:
        """All customers of all dishes leave and sit down again, where the parents' measures are given."""
        x = self.discount * self.masses() * parent
        self.tables = draw_tables(self.customers, self.tables, x, self.discount, self.rng)

    def shares(self) -> np.ndarray:
        """Each dish's share of its context's measure in the tables here, given the seating (Dirichlet)."""
        own = self.rng.gamma(np.maximum(self.customers - self.discount * self.tables, 0))
        t = np.bincount(self.context, self.tables, self.n_contexts)
        rest = self.rng.gamma(self.strength + self.discount * t)
        return own / (np.bincount(self.context, own, self.n_contexts) + rest)[self.context]

    def measure(self, parent: np.ndarray) -> np.ndarray:
        """Each dish's probability, drawn given the seating and the parents' measures (all dishes are listed)."""
        own = self.rng.gamma(np.maximum(self.customers - self.discount * self.tables, 0))
        own += tilted_stable(self.masses() * parent, self.discount, self.rng)
        return own / np.bincount(self.context, own, self.n_contexts)[self.context]

    def draw_under(self, parent: Restaurants, up: np.ndarray) -> np.ndarray:
        """``draw`` with the parents' seating in the weights; ``up``: each dish's dish there.

        Given the parent's shares and numbers of tables, the children of one of its dishes weigh
        what they weigh in ``draw``, times the seatings of their tables (its customers) at its
        tables over gamma(customers - discount * tables). Each part is drawn by the former and
        kept by the latter (Metropolis). The parent's customers follow. Returns how many were kept.
        """
        x = self.discount * self.masses() * parent.shares()[up]
        seated = np.flatnonzero(self.customers)
        part = self.rng.integers(PARTS, size=len(seated))
        kept = np.zeros(2)

        def weight(dishes: np.ndarray, customers: np.ndarray) -> np.ndarray:
            t = parent.tables[dishes]
            room = np.maximum(customers, t) - parent.discount * t
            return log_seatings(customers, t, parent.discount) - _log_gamma(room)

        for i in range(PARTS):
            at = seated[part == i]
            new = draw_tables(self.customers[at], self.tables[at], x[at], self.discount, self.rng)
            more = np.bincount(up[at], new - self.tables[at], len(parent.keys)).astype(np.int64)
            moved = np.flatnonzero((more != 0) & (parent.tables > 1))  # one table seats all in one way
            was, is_ = parent.customers[moved], (parent.customers + more)[moved]
            take = np.ones(len(parent.keys), bool)
            take[moved] = np.log(self.rng.random(len(moved))) < weight(moved, is_) - weight(moved, was)
            kept += take[moved].sum(), len(moved)
            parent.customers = parent.customers + np.where(take, more, 0)
            self.tables[at] = np.where(take[up[at]], new, self.tables[at])
        return kept

    def reseat(self, parent: np.ndarray) -> np.ndarray:
        """``draw``, and who sits where (all tables but a dish's first have one customer); change of tables by dish."""
        before = self.tables
        self.draw(parent)
        self.at = np.repeat(np.arange(len(self.keys)), self.tables)
        self.size = np.ones(len(self.at), np.int64)
        seen = np.flatnonzero(self.tables)
        self.size[(np.cumsum(self.tables) - self.tables)[seen]] += (self.customers - self.tables)[seen]
        return self.tables - before

    def follow(self, change: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Customers by dish come (or go) as the tables below did; the change of tables here."""
        out = np.zeros(len(self.keys), np.int64)
        change = change.copy()
        while (gone := np.flatnonzero(change < 0)).size:
            out[self.leave(gone)] -= 1
            change[gone] += 1
        while (come := np.flatnonzero(change > 0)).size:
            out[self.enter(come, parent)] += 1
            change[come] -= 1
        return out


def sweep(levels: list[Restaurants], ups: list[np.ndarray], parent_of_last: np.ndarray) -> np.ndarray:
    """Gibbs: every dish's number of tables anew, from the leaves up, given all the others."""
    kept = [level.draw_under(levels[i + 1], up) for i, (level, up) in enumerate(zip(levels, ups))]
    levels[-1].draw(parent_of_last)
    return np.array(kept)


def gibbs(grams: np.ndarray, n: np.ndarray, top: int, bottom: int, base, seed: int, mean=None):
    """Gibbs sampling of the restaurants of orders bottom..top over sorted distinct n-grams.

    ``base``: probability of the dishes of order ``bottom`` in their parents, from their keys;
    ``mean``: the same to predict with (else ``base``). Returns each n-gram's averaged predictive
    probability, the restaurants (leaves first) and each dish's dish in the next.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    levels, ups = [], []
    keys = grams
    for order in range(top, bottom - 1, -1):
        if order < top:
            keys, up = np.unique(keys & ((1 << 8 * order) - 1), return_inverse=True)
            ups.append(up)
        levels.append(Restaurants(keys, order, rng))
    customers = n
    for i, level in enumerate(levels):
        level.spread(customers)
        if i < len(ups):
            customers = np.bincount(ups[i], level.tables, len(levels[i + 1].keys)).astype(np.int64)
    parent_of_last = base(levels[-1].keys)
    predicted_last = (mean or base)(levels[-1].keys)
    total = np.zeros(len(grams))
    for i in range(BURN_IN + SAMPLES):
        sweep(levels, ups, parent_of_last)
        if i >= BURN_IN:
            p = predicted_last
            for j in range(len(levels) - 1, -1, -1):
                p = levels[j].predictive(p)
                if j:
                    p = p[ups[j - 1]]
            total += p
    return total / SAMPLES, levels, ups


def sample(grams: np.ndarray, n: np.ndarray, top: int, bottom: int, base, seed: int, mean=None) -> tuple[np.ndarray, np.ndarray]:
    """``gibbs``: the averaged predictive probabilities and, for the dishes of order ``bottom``
    (as their keys are listed by ``dishes``), the last numbers of tables."""
    p, levels, _ = gibbs(grams, n, top, bottom, base, seed, mean)
    return p, levels[-1].tables


def dishes(grams: np.ndarray, order: int) -> np.ndarray:
    return np.unique(grams & ((1 << 8 * order) - 1))


def _uniform(keys: np.ndarray) -> np.ndarray:
    return np.full(len(keys), 1 / SYMBOLS)


def above(customers: dict[int, int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """P(symbol | one context symbol) from customers by (context, symbol): predicted, and a draw of the measures."""
    keys = np.arange(1 << 16, dtype=np.int64)
    n = np.zeros(1 << 16, np.int64)
    for key, c in customers.items():
        n[key] = c
    p, (pairs, singles), (up,) = gibbs(keys, n, 2, 1, _uniform, seed)
    drawn = pairs.measure(singles.measure(_uniform(singles.keys))[up])
    return p.reshape(256, 256), drawn.reshape(256, 256)


def upper(customers: dict[int, int], seed: int) -> np.ndarray:
    """P(symbol | one context symbol) as a (256, 256) table, from customers by (context, symbol)."""
    return above(customers, seed)[0]


def _group_rows(grams: DataFrame, groups: int) -> DataFrame:
    tail = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.select("key", "n", F.pmod(F.xxhash64(tail), F.lit(groups)).alias("group"))


def probabilities(grams: DataFrame, groups: int) -> DataFrame:
    """(key, p): log10 of the averaged predictive probability of every listed n-gram."""

    def base(table: np.ndarray):
        return lambda keys: table[(keys >> 8) & 0xFF, keys & 0xFF]

    def summed(table: np.ndarray):
        def run(rows: pa.Table) -> pa.Table:
            key, n = _sorted(rows)
            tables = sample(key, n, ORDER, 3, base(table), 1)[1]
            pair, count = _summed([dishes(key, 3) & 0xFFFF], [tables])
            return pa.table({"key": pair, "n": count})

        return run

    def final(table: np.ndarray, mean: np.ndarray):
        def run(rows: pa.Table) -> pa.Table:
            key, n = _sorted(rows)
            return pa.table({"key": key, "p": np.log10(sample(key, n, ORDER, 3, base(table), 2, base(mean))[0])})

        return run

    def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(key)
        return key[order], n[order]

    dealt = _group_rows(grams, groups)
    # First tables of order 3: one for each distinct (two context symbols, symbol) that was seen.
    pair = F.col("key").bitwiseAND(F.lit(0xFFFF))
    seen = grams.where("n > 0").select(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).distinct()
    first = {r["pair"]: r["n"] for r in seen.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n")).collect()}
    _, table = above(first, 11)
    tables = dealt.groupBy("group").applyInArrow(summed(table), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    mean, table = above({r["key"]: r["n"] for r in tables.collect()}, 12)  # at most 256 * 256 rows
    return dealt.groupBy("group").applyInArrow(final(table, mean), "key long, p double")


def _answers(dealt: DataFrame, keys_of, values: DataFrame, n_blocks: int) -> DataFrame:
    """The values of the keys that each block of ``dealt`` holds; ``keys_of``: blocks and keys of batches."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_block: dict[int, list[np.ndarray]] = {}
        for block, keys in keys_of(batches):
            by_block.setdefault(block, []).append(_distinct(keys))
        for b, keys in by_block.items():
            key = _distinct(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b)), pa.array(key)], names=["block", "key"])

    asked = dealt.mapInArrow(ask, "block long, key long")
    return asked.join(values, "key").select("block", *values.columns).repartition(n_blocks, "block")


def spelled(words: DataFrame, n_words: int, grams: DataFrame) -> DataFrame:
    """(key, n, base): the probability of each word's (key, n, spelling) spelling."""
    n_blocks = max(2 * words.sparkSession.sparkContext.defaultParallelism, -(-n_words // BLOCK_WORDS))
    dealt = words.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).repartition(n_blocks, "block")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in _many(batches, BLOCK_WORDS):
            block = batch.column("block").to_numpy()
            own, sizes = grams_of_spellings(batch.column("spelling"))
            for b in np.unique(block):
                yield int(b), own[np.repeat(block == b, sizes)]

    def judge(rows: pa.Table, slice_: pa.Table) -> pa.Table:
        look_up = Values(slice_.column("key").to_numpy(), slice_.column("p").to_numpy()).of
        if not rows.num_rows:
            return pa.table({"key": np.empty(0, np.int64), "n": np.empty(0, np.int64), "base": np.empty(0)})
        own, sizes = grams_of_spellings(rows.column("spelling").combine_chunks())
        base = 10.0 ** np.add.reduceat(look_up(own), np.cumsum(sizes) - sizes)
        return pa.table({"key": rows.column("key"), "n": rows.column("n"), "base": base})

    found = _answers(dealt, keys_of, grams.select("key", "p"), n_blocks)
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(judge, "key long, n long, base double")


def _many(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def word_tables(words: DataFrame, alone: int, seed: int) -> DataFrame:
    """(key, n, tables): averaged numbers of tables of the words (key, n, base) in their shared restaurant.

    Gibbs, as for the symbols: given the restaurant's mass the words are independent. A word's
    n customers are at ``base``, the probability of its spelling, in the parent. ``alone``: tables
    of words with one customer, which are not listed.
    """
    names = ["key", "n", "base", "now", "tables"]
    schema = "key long, n long, base double, now long, tables double"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            now = np.clip(np.rint(START * n.astype(float) ** WORD_DISCOUNT).astype(np.int64), 1, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now), pa.array(np.zeros(len(n)))], names=names)

    def drawn(mass: float, sweep_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _many(batches, BLOCK_WORDS):
                key, n, base, now, tables = (c.to_numpy() for c in batch.columns)
                rng = np.random.default_rng([seed, sweep_, *key[:1].view(np.uint64).tolist()])
                now = draw_tables(n, now, WORD_DISCOUNT * mass * base, WORD_DISCOUNT, rng)
                if sweep_ >= BURN_IN:
                    tables = tables + now / SAMPLES
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(now), pa.array(tables)], names=names)

        return run

    rng = np.random.default_rng(seed)
    state = staged(words.select("key", "n", "base").mapInArrow(start, schema), "word-tables")
    for i in range(BURN_IN + SAMPLES):
        listed = state.agg(F.coalesce(F.sum("now"), F.lit(0))).first()[0]
        mass = float(rng.gamma(WORD_STRENGTH / WORD_DISCOUNT + alone + listed))
        state = state.mapInArrow(drawn(mass, i), schema)
        if i % 2:  # every second state is written; one between is drawn twice, alike
            state = staged(state, "word-tables")
    return state.select("key", "n", "tables")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "held_out", held_out()
    )
    counted = staged(counts(docs), "counts")
    known = counted.where("key < 0 AND n > 0")
    n_train, n_types, alone = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = staged(probabilities(counted.where("key >= 0").select("key", "n"), groups), "probabilities")
    # One customer sits at one table.
    words = word_tables(spelled(known.where("n > 1"), n_types - alone, grams), alone, 13)
    n_tables = alone + words.agg(F.coalesce(F.sum("tables"), F.lit(0.0))).first()[0]
    words = words.union(known.where("n = 1").select("key", "n", F.lit(1.0)))
    values = words.select("key", F.col("n").cast("double").alias("value"), "tables").union(grams.select("key", "p", F.lit(0.0)))

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition(n_blocks, "block")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in pieces(batches, size=PIECE_BYTES):
            block = batch.column("block").to_numpy()
            own, tokens, sizes, n_tokens = symbols_of(batch.column("text"))
            for b in np.unique(block):
                mine = np.repeat(block == b, n_tokens)
                yield int(b), np.concatenate([own[np.repeat(mine, sizes)], tokens[mine]])

    answers = _answers(dealt, keys_of, values, n_blocks)
    shift = float(np.log10(n_train + n_types + 1))

    def judge(rows: pa.Table, slice_: pa.Table) -> pa.Table:
        answers_ = Values(*(slice_.column(c).to_numpy() for c in ("key", "value", "tables")))
        parts = []
        for batch in pieces(iter(rows.to_batches()), size=PIECE_BYTES):
            grams, tokens, sizes, n_tokens = symbols_of(batch.column("text"))
            count, tables = answers_.all(tokens)
            base = 10.0 ** np.add.reduceat(answers_.of(grams), np.cumsum(sizes) - sizes)
            word = count - WORD_DISCOUNT * tables + (WORD_STRENGTH + WORD_DISCOUNT * n_tables) * base
            word = word / (WORD_STRENGTH + n_train)
            at, earlier, own, all_ = seat(tokens, n_tokens, word)
            text = earlier - TEXT_DISCOUNT * own + (TEXT_STRENGTH + TEXT_DISCOUNT * all_) * word
            text = text / (TEXT_STRENGTH + at)
            sums = lambda x, n=n_tokens: np.add.reduceat(x, np.cumsum(n) - n)
            parts.append(
                pa.table(
                    {
                        "doc_id": batch.column("doc_id"),
                        "held_out": batch.column("held_out"),
                        "n_tokens": n_tokens,
                        "n_known": sums((count > 0).astype(np.int64)),
                        "train_tokens": np.full(len(n_tokens), n_train),
                        "base_score": sums(np.log10(count + 1)) - n_tokens * shift,
                        "score": sums(np.log10(text + 1e-300)),
                    }
                )
            )
        return pa.concat_tables(parts)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)


def digest(docs: DataFrame) -> DataFrame:
    return score(docs)

"""Problem 9: held-out evaluation passages inside training texts.

The evaluation items are a fixed, small table: their normalised word n-grams
are broadcast as a set of gram numbers (in parts, if they are large).  One scan slides over every
text's words; windows with enough hits of one item are verified by an exact
alignment, whose spans are reported and can be cut out of the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import settled, spread

#: A leak: so many consecutive words of an item, with at most one edit in EDIT_IN of them.
MIN_WORDS, EDIT_IN = 25, 6
GRAM = 3
#: n-gram lemma: 25 words with 4 edits keep at least 25 - 3 + 1 - 3 * 4 = 11 grams; the
#: lower floor leaves room for a word whose damage hides it from the hash set.
MIN_HITS = 8
MAX_ITEM_BYTES = 64 << 20

_WORD = re.compile(r"[a-z0-9]+")
_RAW = re.compile(r"\S+")


def _strip(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


class Items:
    """The evaluation items as words, and where their n-grams stand."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words: dict[int, list[str]] = {}
        self.weights: dict[int, np.ndarray] = {}
        self.units: dict[int, np.ndarray] = {}
        self.least: dict[int, list[float]] = {}  # the least cost of an edit within each n-gram
        grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, text in rows:
            words, weights, units = [], [], []
            for unit, raw in enumerate(_RAW.findall(_strip((text or "").lower()))):
                parts = _WORD.findall(raw)  # a hyphened word is one word of the item
                words += parts
                weights += [1 / len(parts)] * len(parts)
                units += [unit] * len(parts)
            if len(set(units)) < MIN_WORDS:
                continue
            self.words[item], self.weights[item], self.units[item] = words, np.array(weights), np.array(units)
            self.least[item] = [min(weights[k : k + GRAM]) for k in range(len(words) - GRAM + 1)]
            for k in range(len(words) - GRAM + 1):
                grams[tuple(words[k : k + GRAM])].append((item, k))
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for ws in self.words.values() for w in ws))}
        self.grams = {self._code([self.ids[w] for w in g]): places for g, places in grams.items()}
        self.codes = np.array(sorted(self.grams), dtype=np.int64)
        self.readings: dict[str, list] = {}
        self.lengths: dict[int, list[str]] = defaultdict(list)
        for w in self.ids:
            self.lengths[len(w)].append(w)

    def _code(self, ids):
        """One number for GRAM word numbers (also arrays of them)."""
        out = ids[0]
        for i in ids[1:]:
            out = out * len(self.ids) + i
        return out

    def read(self, raw: str) -> list:
        """Words of a token with characters beyond ASCII, in lower case: texts, or a tuple of the item words it may be.

        It is read without its odd characters, as accented, as parted by them,
        or as damaged, whichever gives words of the items.
        """
        if raw not in self.readings:
            if len(self.readings) > 200_000:
                self.readings.clear()  # a memory of readings, nothing else
            self.readings[raw] = self._read(raw)
        return self.readings[raw]

    def _read(self, raw: str) -> list:
        known = lambda words: words and all(w in self.ids for w in words)
        apart, stripped = _WORD.findall(raw), _WORD.findall(_strip(raw))
        if known(apart):
            return apart
        if known(stripped):
            return stripped
        if any(w in self.ids for w in apart):
            return apart
        return [fit] if (fit := self._fitting(raw, apart)) else stripped

    def _fitting(self, raw: str, kept: list[str]) -> tuple[str, ...]:
        """All item words that fit a damaged token, odd characters standing for up to three letters each."""
        least = sum(map(len, kept))
        if not least:
            return ()
        most = least + 3 * (len(raw) - least)
        near = [w for n, ws in self.lengths.items() if least <= n <= most for w in ws]
        body = re.compile(re.sub(r"[^a-z0-9]+", lambda m: f".{{0,{3 * len(m.group())}}}", raw))
        return tuple(w for w in near if body.fullmatch(w))

    def words_of(self, text: str) -> list:
        """Normalised words of a text; case, punctuation and line marks fall away."""
        tokens = text.lower().split()
        odd = [i for i, t in enumerate(tokens) if not t.isascii()]
        if not odd:
            return _WORD.findall(" ".join(tokens))
        out, at = [], 0
        for i in odd:
            if at < i:
                out += _WORD.findall(" ".join(tokens[at:i]))
            out += self.read(tokens[i])
            at = i + 1
        return out + _WORD.findall(" ".join(tokens[at:]))

    def places_of(self, text: str) -> list[tuple[int, int]]:
        """Where each of ``words_of`` stands in the text."""
        places = []
        for m in _RAW.finditer(text):
            raw = m.group().lower()
            places += [m.span()] * len(_WORD.findall(raw) if raw.isascii() else self.read(raw))
        return places

    def hits(self, words: list) -> list[tuple[int, int]]:
        """(position, gram) of all item n-grams among the words; a damaged word stands for each word it may be."""
        if len(words) < GRAM or not len(self.codes):
            return []
        get = self.ids.get
        ids = np.array([get(w, -1) if type(w) is str else -1 for w in words], dtype=np.int64)
        windows = [ids[k : len(ids) - GRAM + 1 + k] for k in range(GRAM)]
        at = np.flatnonzero(np.logical_and.reduce([w >= 0 for w in windows]))
        found = []
        if len(at):
            codes = self._code([w[at] for w in windows])
            there = self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] == codes
            found = list(zip(at[there].tolist(), codes[there].tolist()))
        damaged = [i for i, w in enumerate(words) if type(w) is tuple]
        for k in sorted({k for i in damaged for k in range(max(0, i - GRAM + 1), min(i, len(words) - GRAM) + 1)}):
            options = [[get(x) for x in w] if type(w) is tuple else [get(w)] for w in words[k : k + GRAM]]
            if all(None not in o for o in options):
                found += [(k, c) for c in {self._code(g) for g in product(*options)} if c in self.grams]
        return found


def _candidates(items: Items, words: list) -> dict[int, list[tuple[int, int, set[int]]]]:
    """item -> [(from, to, n-grams of the item met there)] regions of the text's words that may hold a leak."""
    found = items.hits(words)
    if len(found) < MIN_HITS:
        return {}
    places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, gram in found:
        for item, at in items.grams[gram]:
            places[item][k].append(at)
    out: dict[int, list[tuple[int, int, set[int]]]] = {}
    for item, held in places.items():
        if len(held) < MIN_HITS:
            continue
        n = len(items.words[item])
        spread, regions = n + n // EDIT_IN + 1, []
        order = sorted(held)
        lo = 0
        for hi, p in enumerate(order):
            while p - order[lo] > spread:
                lo += 1
            if hi - lo + 1 >= MIN_HITS:
                a, b = max(0, order[lo] - spread), min(len(words), p + GRAM + spread)
                if regions and a <= regions[-1][1]:
                    regions[-1] = (regions[-1][0], b)
                else:
                    regions.append((a, b))
        if regions:
            out[item] = [(a, b, {at for k in order if a <= k < b for at in held[k]}) for a, b in regions]
    return out


def _heads(items: Items, item: int, met: set[int]) -> Iterator[tuple[int, int]]:
    """(first word, last word worth looking at) of the item's stretches that the n-grams met don't rule out.

    Every n-gram of a stretch that isn't met holds an edit; n-grams that share
    no word can't share one.
    """
    unit, least = items.units[item].tolist(), items.least[item]
    n, end = len(unit), unit[-1]
    for a in range(n):
        if a and unit[a] == unit[a - 1]:
            continue  # stretches begin with whole words
        room = end - unit[a] + 1
        if room < MIN_WORDS:
            break
        cost, until, k = 0.0, -1, a
        while k <= n - GRAM:
            if k in met:
                k += 1
            else:
                cost += least[k]
                k += GRAM
                if cost * EDIT_IN > room + 1e-9:
                    break
            last = min(n, k + GRAM - 1) - 1  # the last word before the next n-gram is whole
            length = unit[last] - unit[a] + 1
            if length >= MIN_WORDS and cost * EDIT_IN <= length + 1e-9:
                until = last
        if until >= 0:
            yield a, until


def best_span(items: Items, item: int, words: list, met: set[int] | None = None, longest: bool = True) -> tuple[int, int] | None:
    """(from, to) in ``words`` of the first stretch of the item that leaked, at its longest (or the first length that is a leak).

    For every first word of a stretch that the n-grams ``met`` allow, one
    edit-distance pass over all later last words; insertions cost one word, a
    changed or dropped item word its share of the (hyphened) word it belongs to.
    """
    mine, weight, unit = items.words[item], items.weights[item], items.units[item]
    codes = {w: i for i, w in enumerate(dict.fromkeys(mine))}
    text = np.array([codes.get(w, -1) if type(w) is str else -1 for w in words])
    own = np.array([codes[w] for w in mine])
    alike = {c: text == c for c in codes.values()}
    for j, w in enumerate(words):
        if type(w) is tuple:  # a damaged word is every word it may be
            for x in w:
                if x in codes:
                    alike[codes[x]][j] = True
    m, steps = len(text), np.arange(len(text) + 1)
    met = set(range(len(mine))) if met is None else met
    heads = _heads(items, item, met)
    for a, until in heads if longest else sorted(heads, key=lambda h: (h[0] not in met, h[0])):  # likely ones first
        cost = np.zeros(m + 1)
        begin = steps.copy()
        best = None
        for i in range(a, until + 1):
            same = alike[own[i]]
            ends = np.where(same, cost[:-1], np.inf)  # a stretch begins and ends with words that are there
            change = np.where(same, 0.0, weight[i] if i > a else np.inf)
            drop = cost + (weight[i] if i > a else np.inf)
            move = np.concatenate(([np.inf], cost[:-1] + change))
            new, before = np.minimum(drop, move), begin
            origin = np.where(move <= drop, np.concatenate(([0], begin[:-1])), begin)
            slack = np.minimum.accumulate(new - steps)
            better = slack + steps < new - 1e-9
            if better.any():
                src = np.maximum.accumulate(np.where(new - steps <= slack + 1e-9, steps, 0))
                origin = np.where(better, origin[src], origin)
                new = slack + steps
            cost, begin = new, origin
            length, least = unit[i] - unit[a] + 1, cost.min()
            # a leak can always be shortened at its head to one whose overdrawn
            # heads leave fewer than MIN_WORDS words behind them
            if least * EDIT_IN > length + MIN_WORDS + EDIT_IN:
                break
            if length >= MIN_WORDS and (i + 1 == len(mine) or unit[i + 1] != unit[i]):
                j = int(ends.argmin())
                if ends[j] * EDIT_IN <= length + 1e-9:
                    best = (int(before[j]), j + 1)
                    if not longest:
                        return best
        if best:
            return best
    return None


def stretches(items: Items, item: int, words: list, a: int, b: int, met: set[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of all leaked stretches of the item in a region; both sides of each are searched again.

    A long region is searched in windows that overlap by the longest stretch, so
    a passage repeated many times costs in proportion to the text.
    """
    n = len(items.words[item])
    step = 3 * (n + n // EDIT_IN + 1)
    todo = [(x, min(b, x + step * 4 // 3), met) for x in range(a, max(a + 1, b - step // 3), step)]
    while todo:
        x, y, met = todo.pop()
        span = best_span(items, item, words[x:y], met)
        if span:
            start, stop = x + span[0], x + span[1]
            yield start, stop
            for p, q in ((x, start), (stop, y)):
                todo += [(p + c, p + d, m) for c, d, m in _candidates(items, words[p:q]).get(item, ())]


def leaks_in(items: Items, text: str | None) -> list[tuple[int, int, int]]:
    """(item, from, to): leaked items of a text and the characters they take."""
    if not text:
        return []
    words = items.words_of(text)
    regions_of = _candidates(items, words)
    if not regions_of:
        return []
    places, out = items.places_of(text), []
    for item, regions in sorted(regions_of.items()):
        for a, b, met in regions:
            out += [(item, places[start][0], places[stop - 1][1]) for start, stop in sorted(stretches(items, item, words, a, b, met))]
    return out


def items_in(items: Items, text: str | None) -> list[int]:
    """The leaked items of a text, where their spans aren't asked for."""
    words = items.words_of(text) if text else []
    found = []
    for item, regions in sorted(_candidates(items, words).items()):
        if any(best_span(items, item, words[a:b], met, longest=False) for a, b, met in regions):
            found.append(item)
    return found


def _item_parts(eval_items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items on the driver, in parts of at most MAX_ITEM_BYTES each (one, for any usual table), to be broadcast one by one."""
    held = eval_items.where("item_id is not null and text is not null")
    size = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = -(-2 * size // MAX_ITEM_BYTES) if size > MAX_ITEM_BYTES else 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [[(r.item_id, r.text) for r in (held.where(part == k) if n > 1 else held).select("item_id", "text").collect()] for k in range(n)]


def _spans(documents: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
    rows = documents.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value)
        for batch in batches:
            found = [
                (doc, *leak) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for leak in leaks_in(items, text)
            ]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "item_id", "start", "stop"])

    slim = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    return slim.mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, stop bigint")


def leaked_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, stop: leaked stretches by character position.

    Null and empty texts leak nothing; an item without 25 words is never
    leaked; copies of a text are reported each.  Items beyond MAX_ITEM_BYTES
    are taken in parts, a scan of the texts for each.
    """
    return reduce(DataFrame.unionByName, [_spans(documents, part) for part in _item_parts(eval_items)])


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id, once per document and item; cases as in ``leaked_spans``."""
    slim = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")

    def scan(part: list[tuple[int, str]]) -> DataFrame:
        rows = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(rows.value)
            for batch in batches:
                found = [(doc, item) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for item in items_in(items, text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "item_id"])

        return slim.mapInArrow(run, "doc_id bigint, item_id bigint")

    return reduce(DataFrame.unionByName, [scan(part) for part in _item_parts(eval_items)]).distinct()


def remove_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, text`` of the affected documents with the leaked stretches cut out.

    With items in several parts, rounds over all parts are written down until
    one cuts nothing more.
    """
    parts = _item_parts(eval_items)
    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    done = texts.select("doc_id", "text", F.lit(False).alias("cut"), F.lit(False).alias("new"))
    for part in parts:
        done = _cut(done, part)
    if len(parts) > 1:
        done = settled(done, "cut")
        while done.where("new").limit(1).count():
            again = done.withColumn("new", F.lit(False))
            for part in parts:
                again = _cut(again, part)
            done = settled(again, "cut")
    return done.where("cut").select("doc_id", "text")


def _cut(done: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
    """``done`` (doc_id, text, cut, new) after one more part: rows keep their place, so nothing is joined."""
    rows = done.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value)
        for batch in batches:
            texts, cut, new = (batch[c].to_pylist() for c in ("text", "cut", "new"))
            for i, text in enumerate(texts):
                # what stood around a cut may leak once it is joined
                while spans := sorted((a, b) for _, a, b in leaks_in(items, text)):
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(text[at : max(at, a)])
                        at = max(at, b)
                    text = "".join(kept) + text[at:]
                    cut[i] = new[i] = True
                texts[i] = text
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(cut, pa.bool_()), pa.array(new, pa.bool_())], ["doc_id", "text", "cut", "new"])

    return done.mapInArrow(run, "doc_id bigint, text string, cut boolean, new boolean")

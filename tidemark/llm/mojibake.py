"""Problem 10: text decoded with the wrong character encoding.

A noisy channel: the true text was written in one encoding and read in
another, perhaps twice, perhaps losing bytes.  Every distinct token that holds
characters beyond ASCII becomes a byte lattice per wrong reading, with
wildcards where bytes were lost.  A Viterbi search under the corpus' character
frequencies proposes what the token was, and the corpus' word frequencies
decide between proposals.  Tokens are judged once each, however often they
occur.  Copies of a text never speak for its damage: what may be a wrong
reading counts once per distinct text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import settled, shared_dir

#: Wrong readings that are considered.
READINGS = (
    "cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1254", "cp1253", "cp866", "koi8_r", "mac_cyrillic",
)
#: Log cost of a decoding step, and the gain over the token as it stands from which it counts as damaged.
STEP_COST, LEAST_GAIN = 4.0, 2.0
#: A proposal from word frequencies must be so many times as common as the damaged form; one that is valid UTF-8
#: throughout, as common as if the damaged form stood in one text.
WORD_RATIO = 4
LOST = "�"
_SMOOTH = 0.5
_MAX_PIECE = 2000
_MARKS = "’‘“”–—«»¿¡°"

# a token: ASCII letters joined by characters beyond ASCII, in loops that neither recurse nor go back;
# a no-break space joins only where a character beyond ASCII precedes it
TOKEN = r"""["'`(]?(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F][A-Za-z[^\x00-\x7F]]*+["'`)]?"""
SPACING = r"(?<![^\x00-\x7F\xA0])\xA0"
# the same two for the workers, where a class can't hold a class
_SPACING = re.compile(SPACING)
_TOKEN = re.compile(r"""["'`(]?(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F](?:[A-Za-z]|[^\x00-\x7F])*+["'`)]?""")
_OPEN, _CLOSE = "\"'`(“‘«„‹‚", "\"'`)”’»“›‘"


@lru_cache(maxsize=None)
def _bytes_of(reading: str) -> dict[str, int]:
    """Character -> byte of a wrong reading.  Bytes it doesn't define pass as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(reading)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if reading == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def readable() -> str:
    """Pattern (of Java) of what some reading takes for a UTF-8 sequence, lost bytes included."""
    out = []
    for reading in READINGS:
        table = _bytes_of(reading)
        marks = lambda a, b, more="": "[" + "".join(f"\\x{{{ord(c):x}}}" for c, x in table.items() if a <= x <= b) + more + "]"
        rest = marks(0x80, 0xBF, f"\\x{{{ord(LOST):x}}}")
        out += [marks(0xF0, 0xF4) + rest * 3, marks(0xE0, 0xEF) + rest * 2, marks(0xC2, 0xDF) + rest]
    return "|".join(out)


def quoted_only(token: str) -> bool:
    """Whether the token merely quotes a sequence: quote marks around characters without ASCII letters."""
    if len(token) < 3 or token[0] not in _OPEN or token[-1] not in _CLOSE:
        return False
    return not any(c.isascii() and c.isalpha() for c in token[1:-1])


class Characters:
    """Log frequencies of the corpus' characters beyond ASCII, and look-up by UTF-8 bytes."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + _SMOOTH * 65536
        self.top = math.log(total)
        self.cost_of = {c: self.top - math.log(n + _SMOOTH) for c, n in counts.items()}
        self.unseen = self.top - math.log(_SMOOTH)
        self.known: dict[int, list[tuple[bytes, str]]] = {}
        for c in sorted(counts):
            raw = c.encode("utf-8", "ignore")
            if c != LOST and len(raw) > 1:
                self.known.setdefault(len(raw), []).append((raw, c))

    def cost(self, c: str) -> float:
        return 0.0 if c.isascii() else self.cost_of.get(c, self.unseen)

    def fits(self, lattice: tuple) -> list[str]:
        """Known characters whose bytes agree with the lattice (None: any byte)."""
        return [c for raw, c in self.known.get(len(lattice), ()) if all(x is None or x == y for x, y in zip(lattice, raw))]


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def viterbi(token: str, reading: str, chars: Characters, memo: dict, step_cost: float = STEP_COST) -> tuple[float, str, bool, bool]:
    """(cost, text, stepped, wild) of the best reading of a token's byte lattice as UTF-8.

    A position either keeps its character or starts a UTF-8 sequence; a lost
    character may stand for any continuation byte, and a lead byte may have
    lost its last one altogether.
    """
    table = _bytes_of(reading)
    lattice = [None if c == LOST else -1 if c.isascii() else table.get(c, -1) for c in token]
    n = len(token)
    best: list = [(0.0, -1, "", False, False)] + [(math.inf, -1, "", False, False)] * n
    for i in range(n):
        base = best[i][0]
        keep = base + (chars.unseen if token[i] == LOST else chars.cost(token[i]))
        if keep < best[i + 1][0]:
            best[i + 1] = (keep, i, token[i], False, False)
        lead = lattice[i]
        if lead is None or lead < 0xC2:
            continue
        size = _length(lead)
        part = lattice[i : i + size]
        if size and len(part) == size and all(x is None or 0x80 <= x <= 0xBF for x in part[1:]):
            if None not in part:
                try:
                    options = [bytes(part).decode("utf-8")]
                except UnicodeDecodeError:
                    options = []
            else:
                key = tuple(part)
                options = memo.setdefault(key, chars.fits(key))
            for c in options:
                cost = base + step_cost + chars.cost(c) + (1.0 if None in part else 0.0)
                if cost < best[i + size][0]:
                    best[i + size] = (cost, i, c, True, None in part)
    out, stepped, wild, at = [], False, False, n
    while at > 0:
        _, back, c, s, w = best[at]
        out.append(c)
        stepped, wild, at = stepped or s, wild or w, back
    return best[n][0], "".join(reversed(out)), stepped, wild


def restore_utf8(token: str, chars: Characters, memo: dict) -> str | None:
    """The token as it was before UTF-8 bytes were read wrongly, once or more; null if it wasn't.  Every round shortens it."""
    now, found = token, None
    while True:
        stands = sum(chars.unseen if c == LOST else chars.cost(c) for c in now)
        best = min((viterbi(now, r, chars, memo) for r in READINGS), key=lambda x: x[0])
        if not best[2] or stands - best[0] < LEAST_GAIN or len(best[1]) >= len(now):
            return found
        now = found = best[1]
    return found


@lru_cache(maxsize=None)
def _known_to_readings() -> frozenset[str]:
    return frozenset(c for r in READINGS for c in _bytes_of(r)) | {LOST}


def pieces_of(token: str) -> list[str]:
    """A long token in pieces of about _MAX_PIECE characters, cut only beside characters that no sequence of any reading spans."""
    out, at, inside = [], 0, _known_to_readings()
    for i in range(_MAX_PIECE, len(token)):
        if i - at >= _MAX_PIECE and token[i] not in inside:
            out.append(token[at:i])
            at = i
    return [*out, token[at:]]


def eager_utf8(token: str, chars: Characters, memo: dict) -> dict[str, bool]:
    """Readings as UTF-8 that the characters alone don't make sure of, and whether their bytes are valid without wildcards."""
    out: dict[str, bool] = {}
    for r in READINGS:
        _, parts, steps, wilds = zip(*(viterbi(p, r, chars, memo, -STEP_COST) for p in pieces_of(token)))
        if any(steps):
            text = "".join(parts)
            out[text] = out.get(text, False) or not any(wilds)
    return out


def byte_proposals(token: str) -> set[str]:
    """What the token was if single-byte text was read in another single-byte encoding."""
    out = set()
    odd = [c for c in token if not c.isascii()]
    for reading in READINGS:
        table = _bytes_of(reading)
        if not all(c in table for c in odd):
            continue
        for true in ("cp1252", "mac_roman", "cp437", "cp850"):
            if true == reading:
                continue
            try:
                text = "".join(c if c.isascii() else bytes([table[c]]).decode(true) for c in token)
            except UnicodeDecodeError:
                continue
            if text != token and all(c.isalpha() or c in "’‘“”–—«»¿¡°€£\xa0" for c in text if not c.isascii()):
                out.add(text)
    return out


def cut_tail(token: str, i: int) -> bool:
    """Whether the character may be the lead byte of a sequence whose tail was lost."""
    return 0xC2 <= _bytes_of("cp1252").get(token[i], -1) <= 0xC5 and (i + 1 == len(token) or token[i + 1].isascii())


def open_places(token: str) -> list[int]:
    """Where one character, or the tail of a sequence, may have been lost."""
    return [i for i, c in enumerate(token) if c == LOST or cut_tail(token, i)]


def masked(token: str, places: list[int]) -> str:
    out = list(token)
    for i in places:
        out[i] = LOST
    return "".join(out)


def may_have_been(token: str, word: str) -> bool:
    """Whether a word of the token's length explains all its open places at once."""
    for i, (c, k) in enumerate(zip(token, word)):
        if c == LOST:
            if k == LOST or k.isascii() or not (k.isalpha() or k in _MARKS):
                return False
        elif c != k and not (cut_tail(token, i) and k.encode("utf-8", "replace")[0] == _bytes_of("cp1252")[c] and len(k.encode("utf-8", "replace")) == 2):
            return False
    return word != token


# -- over the corpus -------------------------------------------------------------


def hashed(documents: DataFrame) -> DataFrame:
    """doc_id, text, text_id: copies of a text share its text_id."""
    return documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("text_id"))


def text_tokens(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id) of the texts with odd tokens, and (text_id, copies, token) of each distinct text; written down once for the steps that follow."""
    spark = documents.sparkSession
    rows, texts = shared_dir(spark, "rows"), shared_dir(spark, "tokens")
    spaced = F.when(F.contains("text", F.lit("\xa0")), F.regexp_replace("text", SPACING, " ")).otherwise(F.col("text"))
    found = F.array_distinct(F.regexp_extract_all(spaced, F.lit(TOKEN), F.lit(0)))
    # a text of ASCII alone has as many bytes as characters, and no odd token
    odd = hashed(documents.where(F.octet_length("text") > F.length("text")))
    odd.select("doc_id", "text_id", found.alias("tokens")).where(F.size("tokens") > 0).write.parquet(rows)
    held = spark.read.parquet(rows)
    distinct = held.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"))
    distinct.select("text_id", "copies", F.explode("tokens").alias("token")).write.parquet(texts)
    return held.select("doc_id", "text_id"), spark.read.parquet(texts)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, n, n_texts: in how many texts each token stands, copies included and counted once; written down for the steps that follow."""
    return settled(tokens.groupBy("token").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_texts")), "words")


def character_counts(words: DataFrame) -> dict[str, int]:
    """Counts of all characters beyond ASCII: at most as many rows as Unicode has characters.

    Characters that may be a wrongly read sequence count once per distinct text,
    all others with the copies.
    """
    clear = F.regexp_replace("token", readable(), "")
    parts = F.array(F.struct(F.col("token").alias("t"), F.col("n_texts").alias("n")), F.struct(clear.alias("t"), (F.col("n") - F.col("n_texts")).alias("n")))
    each = words.select(F.inline(parts)).where("n > 0").select(F.explode(F.split(F.regexp_replace("t", r"[\x00-\x7F]", ""), "")).alias("c"), "n")
    rows = each.where("c <> ''").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r.c: r.n for r in rows}


def proposals(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """token, n, restored, kind: what each token may have been.

    kind ``sure``: the characters decide (restored may be null: damaged beyond
    repair); ``word``: holds if the restored form is a far more common word;
    ``utf8``: holds if it is a common word, however common the damaged form is;
    ``lost``: restored still has open places, for fitting_words to fill.
    """
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, memo = Characters(shared.value), {}
        schema = pa.schema([("token", pa.string()), ("n", pa.int64()), ("restored", pa.string()), ("kind", pa.string())])
        for batch in batches:
            out = []
            for token, n in zip(batch["token"].to_pylist(), batch["n"].to_pylist()):
                if quoted_only(token):
                    continue
                pieces = pieces_of(token)
                fixed = [restore_utf8(p, chars, memo) for p in pieces]
                if any(f is not None for f in fixed):
                    text = "".join(p if f is None else f for p, f in zip(pieces, fixed))
                    out.append((token, n, text, "sure"))
                    if LOST in text:
                        out.append((token, n, text, "lost"))
                    continue
                if LOST in token:
                    out.append((token, n, None, "sure"))
                # nothing odd is left but spacing: no word of the vocabulary can tell
                out += [(token, n, m, "sure" if all(c.isascii() or c == "\xa0" for c in m) else "utf8" if valid else "word") for m, valid in eager_utf8(token, chars, memo).items()]
                out += [(token, n, m, "word") for m in byte_proposals(token)]
                if open_places(token):
                    out.append((token, n, token, "lost"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # few bytes, much work: a fixed number of partitions isn't merged by the planner
    width = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return words.repartition(width, "token").mapInArrow(run, "token string, n bigint, restored string, kind string")


def _skeleton(column: str) -> F.Column:
    """Length and ASCII letters of a token."""
    return F.regexp_replace(column, r"[^\x00-\x7F]", "?")


def fitting_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """token, n, restored, kind: every common word that fills all open places of a ``lost`` row, as kind ``word``.

    Words and tokens meet on the letters outside the open places; a word is
    masked only in the ways that tokens of its skeleton are.  Words of
    WORD_RATIO texts and fewer can't hold as proposals and aren't tried.
    """
    schema = "token string, n bigint, restored string, mask string, masked string"

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            places = [open_places(t) for t in pdf["restored"]]
            yield pdf.assign(mask=[",".join(map(str, p)) for p in places], masked=[masked(t, p) for t, p in zip(pdf["restored"], places)])

    def mask_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"word": pdf["word"], "mask": pdf["mask"], "masked": [masked(w, list(map(int, m.split(",")))) for w, m in zip(pdf["word"], pdf["mask"])]})

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            good = pdf[[may_have_been(t, w) for t, w in zip(pdf["restored"], pdf["word"])]]
            yield pd.DataFrame({"token": good["token"], "n": good["n"], "restored": good["word"], "kind": "word"})

    open_ = asked.where("kind = 'lost'").select("token", "n", "restored").mapInPandas(mark, schema)
    masks = open_.select(_skeleton("restored").alias("skeleton"), "mask").distinct()
    common = words.where(F.col("n") > WORD_RATIO).select(F.col("token").alias("word"), _skeleton("token").alias("skeleton"))
    tried = common.join(masks, "skeleton").select("word", "mask").mapInPandas(mask_words, "word string, mask string, masked string")
    return open_.join(tried, ["mask", "masked"]).select("token", "n", "restored", "word").mapInPandas(verify, "token string, n bigint, restored string, kind string")


def far_more_common() -> F.Column:
    """Whether the restored form is WORD_RATIO times as common as the damaged one by distinct texts, or by all texts and no rarer by distinct ones."""
    by_texts = F.col("restored_texts") >= WORD_RATIO * F.col("n_texts") + 1
    by_copies = (F.col("restored_n") >= WORD_RATIO * F.col("n") + 1) & (F.col("restored_texts") >= F.col("n_texts"))
    return by_texts | by_copies | ((F.col("kind") == "utf8") & (F.col("restored_n") > WORD_RATIO))


def damaged_tokens(words: DataFrame) -> DataFrame:
    """token, restored: every damaged token once, with its likeliest original if one was found."""
    proposed = shared_dir(words.sparkSession, "proposed")
    proposals(words, character_counts(words)).write.parquet(proposed)
    asked = words.sparkSession.read.parquet(proposed)
    asked = asked.where("kind <> 'lost'").unionByName(fitting_words(asked, words))
    common = words.select(F.col("token").alias("restored"), F.col("n").alias("restored_n"), F.col("n_texts").alias("restored_texts"))
    ranked = asked.join(words.select("token", "n_texts"), "token").join(common, "restored", "left").withColumn("holds", (F.col("kind") == "sure") | F.coalesce(far_more_common(), F.lit(False)))
    # a common word beats the characters' proposal, which beats none
    rank = F.struct((F.col("restored_n").isNotNull()).cast("int"), F.coalesce("restored_n", F.lit(0)), F.col("restored").isNotNull().cast("int"))
    return ranked.where("holds").groupBy("token").agg(F.max_by("restored", F.struct(rank, "restored")).alias("restored"))


def damaged_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every text with wrongly decoded characters, restorable or not.

    Null and empty texts are none; a text that only quotes such a sequence, and
    properly accented text, are none; copies are reported each.
    """
    rows, tokens = text_tokens(documents)
    texts = tokens.join(damaged_tokens(vocabulary(tokens)), "token").select("text_id").distinct()
    return rows.join(texts, "text_id", "left_semi").select("doc_id").distinct()


def replaced(text: str, known: dict[str, str | None]) -> str:
    """The text with its damaged tokens replaced where they stand as tokens; the same letters inside other tokens stay."""
    out, at = [], 0
    for m in _TOKEN.finditer(_SPACING.sub(" ", text)):
        new = known.get(m.group())
        if new is not None:
            out += [text[at : m.start()], new]
            at = m.end()
    return "".join(out) + text[at:]


def restored_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_restored, n_lost of the affected texts: every damaged token that could be restored is replaced."""
    _, tokens = text_tokens(documents)
    fixes = (
        tokens.join(damaged_tokens(vocabulary(tokens)), "token")
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("token", "restored")).alias("fixes"))  # bounded by one text's tokens
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, good, bad = [], [], []
            for text, fix in zip(pdf["text"], pdf["fixes"]):
                known = {f["token"]: f["restored"] for f in fix}
                texts.append(replaced(text, known))
                good.append(sum(v is not None and LOST not in v for v in known.values()))
                bad.append(sum(v is None or LOST in v for v in known.values()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "n_restored": good, "n_lost": bad})

    return hashed(documents).join(fixes, "text_id").drop("text_id").mapInPandas(run, "doc_id bigint, text string, n_restored bigint, n_lost bigint")

"""Problem 7: the same games in sources that share no identifier.

Cross-table retrieval: every event of a source is a query against an inverted
index of the schedule's games, scored by BM25.  A game is a document of four
attributes (teams, official days, starts, number in a doubleheader), its
versions give the term frequencies and its length, and every attribute value
has its own document frequency.  Both teams must match, and a day or a start;
so only the postings of (team, day) are followed, by one team of each pair an
event may mean.  They give each candidate a lower and an upper bound of its
score, and only candidates whose upper bound reaches the event's second-best
lower bound are scored in full: the best two stay exact.  An event and a game
belong together if each is the other's nearest; the confidence comes from the
score gap through a logistic curve fitted on the events whose game is known.
Events of different sources that belong to one game are a match.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timestamps import normalise
from tidemark.sources import settled

#: BM25: saturation of term frequencies, weight of the document length; at 1 a value that all versions of a game
#: show weighs the same however many versions there are.
K1, B = 1.2, 1.0
#: Starts are counted in slots for their document frequency; a start matches within NEAR_MINUTES, half as well at the edge.
SLOT_MINUTES, NEAR_MINUTES = 30, 90
#: A neighbouring day counts a quarter; among games of a day the nearer start counts up to a fifth of a day more.
NEXT_DAY, DAY_CLOSENESS, DAY_SCALE = 0.25, 0.2, 720
#: An exchange's event first seen this long after a game's last start is unlikely to mean it.
LATE_MINUTES, LATE = 360, 0.3
#: The least share of a misspelt mention's trigram weight that a team's name must hold.
MENTION_SHARE = 0.4
#: The team table is fixed; more rows than this are no team table.
MAX_TEAMS = 20_000
ACCEPT = 0.5
GAP_BINS = 64

_EASTERN = ZoneInfo("America/New_York")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_RECORD = (
    "key string, src string, pairs array<struct<pair: string, weight: double>>, "
    "starts array<struct<minute: bigint, weight: double>>, days array<struct<day: int, weight: double>>, number int, seen bigint, "
    "asks array<struct<team: int, others: map<int,double>>>, wanted array<struct<day: int, weight: double, clock: double>>"
)


def fold(text: str) -> str:
    """Lower case without accents; runs of anything but letters and digits become one space."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", flat.lower()).strip()


# -- teams -----------------------------------------------------------------------


class Teams:
    """Team names as an inverted index: exact forms first, then BM25 over letter trigrams."""

    def __init__(self, rows: list[tuple[int, str, str]], codes: dict[str, int] | None = None):
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.codes: dict[str, set[int]] = defaultdict(set)
        self.grams: dict[str, set[int]] = defaultdict(set)
        names: dict[int, set[str]] = defaultdict(set)
        for team, name, code in rows:
            words = fold(name).split()
            for k in range(len(words)):
                self.exact[" ".join(words[: k + 1])].add(team)
                self.exact[" ".join(words[k:])].add(team)
                if k:
                    self.exact[f"{words[0][0]} {' '.join(words[k:])}"].add(team)
                    self.exact[f"{fold(code)} {' '.join(words[k:])}"].add(team)
            if code:
                self.codes[fold(code)].add(team)
            names[team].update(self._grams(" ".join(words)))
        for code, team in (codes or {}).items():
            self.codes.setdefault(code, {team})
        for team, grams in names.items():
            for g in grams:
                self.grams[g].add(team)
        self.deletes: dict[str, set[str]] = defaultdict(set)
        for form in self.exact:
            for d in self._deletes(form):
                self.deletes[d].add(form)
        n = max(1, len(names))
        self.idf = {g: math.log(1 + (n - len(t) + 0.5) / (len(t) + 0.5)) for g, t in self.grams.items()}
        self.unseen = math.log(1 + (n + 0.5) / 0.5) if n else 0.0
        self.memo: dict[str, dict[int, float]] = {}

    @staticmethod
    def _grams(folded: str) -> set[str]:
        flat = folded.replace(" ", "")
        return {flat[i : i + 3] for i in range(len(flat) - 2)} | {f"^{w[:2]}" for w in folded.split()}

    @staticmethod
    def _deletes(form: str) -> set[str]:
        """The form without its spaces, and with any one letter left out: forms one slip apart share one."""
        flat = form.replace(" ", "")
        return {flat} | ({flat[:i] + flat[i + 1 :] for i in range(len(flat))} if len(flat) > 4 else set())

    def find(self, mention: str) -> dict[int, float]:
        """team -> weight of a mention; weights of equal candidates are equal."""
        m = fold(mention)
        if m not in self.memo:
            self.memo[m] = self._find(m)
        return self.memo[m]

    def _find(self, m: str) -> dict[int, float]:
        if not m:
            return {}
        if m in self.codes:
            return dict.fromkeys(self.codes[m], 1.0)
        if m in self.exact:
            return dict.fromkeys(self.exact[m], 1.0)
        close = set().union(*(self.deletes.get(d, ()) for d in self._deletes(m)))
        if close:
            least = min(abs(len(c) - len(m)) + (sorted(c) != sorted(m)) for c in close)
            near = [c for c in close if abs(len(c) - len(m)) + (sorted(c) != sorted(m)) == least]
            return dict.fromkeys(set().union(*(self.exact[c] for c in near)), 0.9)
        score: Counter = Counter()
        grams = self._grams(m)
        whole = sum(self.idf.get(g, self.unseen) for g in grams)
        for g in grams:
            for t in self.grams.get(g, ()):
                score[t] += self.idf[g]
        if not score or not whole:
            return {}
        return {t: s / whole for t, s in score.items() if s >= MENTION_SHARE * whole}


# -- titles, tickers, times --------------------------------------------------------

_NUMBER = re.compile(r"[\s\-–(]+(?:g|gm|game)\s*\.?\s*(\d)\)?\s*$", re.I)
_TITLE_DAYS = (
    re.compile(r"[,\s\-–]+(?:on\s+)?([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2})\s*\??\s*$"),
    re.compile(r"[,\s\-–]+(?:on\s+)?(\d{1,2})/(\d{1,2})\s*\??\s*$"),
)
_SIDES = re.compile(r"\s+(?:vs?\.?|at|@|beat|/|-|–)\s+", re.I)


def read_title(title: str) -> tuple[list[str], tuple[int, int] | None, int | None]:
    """(mentions, (month, day), game number) of a title."""
    t = " ".join((title or "").split())
    t = re.sub(r"^[A-Z]{2,5}:\s*", "", t)
    number = day = None
    for _ in range(2):
        m = _NUMBER.search(t)
        if m:
            number, t = int(m.group(1)), t[: m.start()]
        for i, form in enumerate(_TITLE_DAYS):
            m = form.search(t)
            if m and day is None:
                month = _MONTHS.index(m.group(1).lower()) + 1 if i == 0 and m.group(1).lower() in _MONTHS else None
                month = int(m.group(1)) if i == 1 else month
                if month and 1 <= month <= 12 and 1 <= int(m.group(2)) <= 31:
                    day, t = (month, int(m.group(2))), t[: m.start()]
    t = re.sub(r"\s*(?:winner|win)?\s*\?\s*$", "", t, flags=re.I)
    t = re.sub(r"^will\s+", "", t, flags=re.I)
    parts = [re.sub(r"^the\s+", "", p.strip(), flags=re.I) for p in _SIDES.split(t)]
    return [p for p in parts if p], day, number


def read_ticker(ticker: str) -> tuple[tuple[int, int, int] | None, int | None, list[list[str]], int | None]:
    """((year, month, day), minute of day, possible code pairs, game number) of an event ticker."""
    parts = (ticker or "").upper().split("-")
    day = minute = number = None
    blobs: list[str] = []
    for p in parts[1:]:
        if m := re.fullmatch(r"(\d\d)([A-Z]{3})(\d\d)(\d{4})?([A-Z]{4,})", p):
            if m.group(2).lower() in _MONTHS:
                day = (2000 + int(m.group(1)), _MONTHS.index(m.group(2).lower()) + 1, int(m.group(3)))
                minute = m.group(4) and int(m.group(4)[:2]) * 60 + int(m.group(4)[2:])
                blobs.append(m.group(5))
        elif m := re.fullmatch(r"(\d\d)(\d\d)(\d\d)", p):
            day = (2000 + int(m.group(3)), int(m.group(1)), int(m.group(2)))
        elif m := re.fullmatch(r"G(\d)", p):
            number = int(m.group(1))
        elif re.fullmatch(r"[A-Z]{5,}", p):
            blobs.append(p)
    if day is None:
        return None, None, [], None
    pairs = []
    for blob in blobs:
        for k in range(2, len(blob) - 1):
            pairs.append([blob[:k], blob[k:]])
            if blob[k] == "V" and len(blob) - k - 1 >= 2:
                pairs.append([blob[:k], blob[k + 1 :]])
    return day, minute, pairs, number


def _day_number(y: int, m: int, d: int) -> int | None:
    try:
        return (datetime(y, m, d) - datetime(1970, 1, 1)).days
    except ValueError:
        return None


def _eastern_minute(day: tuple[int, int, int], minute: int) -> int | None:
    """UTC minute of an eastern clock on an official day; the small hours belong to the day before."""
    try:
        at = datetime(*day, tzinfo=_EASTERN) + timedelta(days=minute < 300)
        return int(at.replace(hour=minute // 60 % 24, minute=minute % 60).astimezone(timezone.utc).timestamp()) // 60
    except ValueError:
        return None


def _days_of(minute: int) -> list[int]:
    """Official days a start can belong to, from the east coast to the west."""
    return sorted({(minute - h * 60) // 1440 for h in (4, 8)})


def team_pairs(sides: list[list[dict[int, float]]]) -> list[tuple[str, float]]:
    """Weighted team pairs from alternative readings, each a list of one candidate set per side."""
    out: dict[str, float] = {}
    for left, right in (s for s in sides if len(s) == 2):
        for a, wa in left.items():
            for b, wb in right.items():
                if a != b:
                    pair = f"{min(a, b)}-{max(a, b)}"
                    out[pair] = max(out.get(pair, 0.0), wa * wb)
    return sorted(out.items())


def asked_teams(pairs: list[tuple[str, float]]) -> list[tuple[int, dict[int, float]]]:
    """(team, {opponent: weight}): few teams that stand in all pairs, so that each pair is sought by one of its teams only."""
    left = {tuple(map(int, p.split("-"))): w for p, w in pairs}
    out = []
    while left:
        often = Counter(t for pair in left for t in pair)
        team = min(often, key=lambda t: (-often[t], t))
        out.append((team, {a + b - team: w for (a, b), w in left.items() if team in (a, b)}))
        left = {pair: w for pair, w in left.items() if team not in pair}
    return out


def wanted_days(starts: list[tuple[int, float]], days: list[tuple[int, float]]) -> list[tuple[int, float, float]]:
    """(day, weight of the day, weight a start on it may have): all days on which a game can share a day or a start."""
    by_day: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for d, w in days:
        for shift in (-1, 0, 1):
            by_day[d + shift][0] = max(by_day[d + shift][0], w if shift == 0 else NEXT_DAY * w)
    for m, w in starts:
        for d in {*_days_of(m - NEAR_MINUTES), *_days_of(m + NEAR_MINUTES)}:
            by_day[d][1] = max(by_day[d][1], w)
    return [(d, *w) for d, w in sorted(by_day.items())]


def _emit(key, src, pairs, starts, days, number, seen) -> tuple:
    starts, days = [x for x in starts if x[0] is not None], [x for x in days if x[0] is not None]
    return (
        key, src, [{"pair": p, "weight": w} for p, w in pairs], [{"minute": m, "weight": w} for m, w in starts],
        [{"day": d, "weight": w} for d, w in days], number, seen, [{"team": t, "others": o} for t, o in asked_teams(pairs)],
        [{"day": d, "weight": w, "clock": c} for d, w, c in wanted_days(starts, days)],
    )


def odds_record(key: str, names: list[str], commence: int | None, seen: int | None, teams: Teams) -> tuple:
    """``names``: JSON pairs of the spellings of both teams, one per variant met."""
    sides = [[teams.find(a), teams.find(b)] for a, b in map(json.loads, names)]
    pairs = team_pairs(sides)
    if commence is None:
        return _emit(key, "odds", pairs, [], [], None, seen)
    return _emit(key, "odds", pairs, [(commence, 1.0)], [(d, 0.6) for d in _days_of(commence)], None, seen)


def kalshi_record(ticker: str, titles: list[str], close: int | None, seen: int | None, teams: Teams) -> tuple:
    day, minute, codes, number = read_ticker(ticker)
    mentions, title_number = [], None
    for t in titles:
        m, _, n = read_title(t)
        title_number = title_number or n
        mentions.append(m)
    by_code = [[teams.codes.get(fold(a)) or set(), teams.codes.get(fold(b)) or set()] for a, b in codes]
    by_code = [s for s in by_code if s[0] and s[1]]
    by_title = [[teams.find(m[0]), teams.find(m[1])] for m in mentions if len(m) == 2]
    singles = [teams.find(m[0]) for m in mentions if len(m) == 1]
    by_title += [[singles[i], singles[j]] for i in range(len(singles)) for j in range(i)]
    named = team_pairs(by_title)
    coded = team_pairs([[dict.fromkeys(s, 1.0) for s in two] for two in by_code])
    both = [p for p in coded if any(p[0] == q for q, _ in named)]
    # one code known and one strange: the titles must hold the known team
    half = []
    if not coded and named:
        known = set().union(*[teams.codes.get(fold(c), set()) for two in codes for c in two]) if codes else set()
        half = [(p, w) for p, w in named if not known or known & set(map(int, p.split("-")))]
    pairs = both or coded or half or named
    if day is None:
        return _emit(f"kalshi:{ticker}", "kalshi", [], [], [], None, seen)
    days = [(_day_number(*day), 1.0)]
    if minute is not None:
        starts = [(_eastern_minute(day, minute), 1.0)]
    else:
        starts = [(close - h * 30, 0.15) for h in range(4, 12)] if close else []
    return _emit(f"kalshi:{ticker}", "kalshi", pairs, starts, days, number or title_number, seen)


def poly_record(key: str, title: str, end: int | None, seen: int | None, teams: Teams) -> tuple:
    mentions, day, number = read_title(title)
    pairs = team_pairs([[teams.find(mentions[0]), teams.find(mentions[1])]]) if len(mentions) == 2 else []
    starts, days = [], []
    year = datetime.fromtimestamp((end if end is not None else seen or 0) * 60, timezone.utc).year
    if end is not None and end % 1440 == 1439:  # the end of a day, not a clock
        days = [(end // 1440, 1.0)]
    elif end is not None:
        # a loose bound: the start itself, three hours on, or either a week later
        starts = [(end - lag, w) for lag, w in ((0, 1.0), (180, 0.95), (10080, 0.8), (10260, 0.8))]
    if day is not None:
        near = [_day_number(y, *day) for y in (year - 1, year, year + 1)]
        near = [d for d in near if d is not None]
        anchor = (end if end is not None else seen or 0) // 1440
        days = [(min(near, key=lambda d: abs(d - anchor)), 1.0)] if near else days
        # a day in the title outweighs the guesses about the start
        starts = [x for x in starts if any(abs(d - days[0][0]) <= 1 for d in _days_of(x[0]))] if near else starts
    return _emit(f"poly:{key}", "poly", pairs, starts, days, number, seen)


# -- the operator ------------------------------------------------------------------


def _team_rows(teams: DataFrame) -> list[tuple[int, str, str]]:
    """The team table on the driver; it is fixed, and its size is checked."""
    rows = teams.select("team_id", "name", "abbreviation").distinct().where("team_id is not null and name is not null")
    if rows.count() > MAX_TEAMS:
        raise ValueError("too many team rows to broadcast")
    return [tuple(r) for r in rows.collect()]


def _minute(ts) -> F.Column:
    return F.floor(F.unix_seconds(ts) / 60).cast("bigint")


def _events(odds: DataFrame, markets: DataFrame, polys: DataFrame) -> DataFrame:
    """One row per event of each source: key, src, names, texts, at, seen.  Repeated snapshots fold before the shuffle."""
    seen = F.min(_minute("as_of_ts")).alias("seen")
    utc = F.lit("UTC")
    o = odds.where("id is not null").groupBy("id").agg(
        F.collect_set(F.to_json(F.array("home_team", "away_team"))).alias("texts"), F.min(_minute(normalise(F.col("commence_time"), utc))).alias("at"), seen
    )
    k = markets.where("event_ticker is not null").groupBy("event_ticker").agg(
        F.collect_set("title").alias("texts"), F.min(_minute(normalise(F.col("close_time"), F.lit("America/New_York")))).alias("at"), seen
    )
    p = polys.where("id is not null").groupBy("id").agg(
        F.array_compact(F.array(F.max("title"))).alias("texts"), F.min(_minute(normalise(F.col("endDate"), utc))).alias("at"), seen
    )
    pick = lambda df, src, key: df.select(F.lit(src).alias("src"), F.col(key).alias("id"), "texts", "at", "seen")
    return pick(o, "odds", "id").unionByName(pick(k, "kalshi", "event_ticker")).unionByName(pick(p, "poly", "id"))


def _code_votes(events: DataFrame, rows) -> dict[str, int]:
    """Strange team codes -> team, by the vote of all tickers whose titles name both teams.

    As many rows reach the driver as there are codes and teams.
    """

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        teams, tally = Teams(rows.value), Counter()
        for pdf in frames:
            for ticker, titles in zip(pdf["id"], pdf["texts"]):
                _, _, codes, _ = read_ticker(ticker)
                pairs = []
                for t in titles:
                    m, _, _ = read_title(t)
                    if len(m) == 2:
                        pairs += team_pairs([[teams.find(m[0]), teams.find(m[1])]])
                if len({p for p, _ in pairs}) != 1:
                    continue
                two = set(map(int, pairs[0][0].split("-")))
                for a, b in codes:
                    known, strange = (a, b) if fold(a) in teams.codes else (b, a)
                    if fold(known) in teams.codes and fold(strange) not in teams.codes and len(strange) == 3:
                        rest = two - teams.codes[fold(known)]
                        if len(rest) == 1:
                            tally[fold(strange), rest.pop()] += 1
        yield pd.DataFrame([(c, t, n) for (c, t), n in tally.items()], columns=["code", "team", "n"]).astype({"team": "int64", "n": "int64"})

    votes = events.where("src = 'kalshi'").select("id", "texts").mapInPandas(vote, "code string, team bigint, n bigint")
    best: dict[str, tuple[int, int]] = {}
    for r in votes.groupBy("code", "team").agg(F.sum("n").alias("n")).collect():
        if r.n > best.get(r.code, (0, 0))[0]:
            best[r.code] = (r.n, r.team)
    return {c: t for c, (_, t) in best.items()}


def event_records(odds: DataFrame, markets: DataFrame, polys: DataFrame, teams: DataFrame) -> DataFrame:
    """key, src, pairs, starts, days, number, seen: what each event says about its game."""
    sc = teams.sparkSession.sparkContext
    events = settled(_events(odds, markets, polys), "events")
    rows = sc.broadcast(_team_rows(teams))
    codes = sc.broadcast(_code_votes(events, rows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Teams(rows.value, codes.value)
        columns = ["key", "src", "pairs", "starts", "days", "number", "seen", "asks", "wanted"]
        for pdf in frames:
            out = []
            for src, key, texts, at, seen in pdf[["src", "id", "texts", "at", "seen"]].itertuples(index=False):
                at, seen = (None if pd.isna(x) else int(x) for x in (at, seen))
                texts = sorted(texts)
                if src == "odds":
                    out.append(odds_record(f"odds:{key}", texts, at, seen, index))
                elif src == "kalshi":
                    out.append(kalshi_record(key, texts, at, seen, index))
                else:
                    out.append(poly_record(key, texts[0] if texts else "", at, seen, index))
            yield pd.DataFrame(out, columns=columns).astype({"number": "Int32", "seen": "Int64"})

    return events.mapInPandas(run, _RECORD).where(F.size("pairs") > 0)


def bm25(tf, idf, norm) -> F.Column:
    """BM25 weight of a term; ``norm`` is K1 times the length factor of the document."""
    return idf * tf * (K1 + 1) / (tf + norm)


def game_index(games: DataFrame) -> DataFrame:
    """game_pk, teams, days, starts, numbers, norm, last_start: the attribute vectors of all games.

    Each attribute value stands with its document frequency as ``idf`` and the
    number of the game's versions that show it as ``tf``; ``norm`` holds the
    length factor.  Rows without a game or a team are left out.
    """
    known = games.where("game_pk is not null and home_team_id is not null and away_team_id is not null")
    number = F.when(F.coalesce("doubleheader", F.lit("N")) != "N", F.col("game_number"))
    values = {"home": "home_team_id", "away": "away_team_id", "day": F.unix_date("game_date_local"), "clock": _minute("scheduled_start_ts"), "number": number}
    cells = F.array(*[F.struct(F.lit(f if f not in ("home", "away") else "team").alias("field"), (F.col(c) if isinstance(c, str) else c).cast("bigint").alias("value")) for f, c in values.items()])
    tf = known.select("game_pk", F.inline(cells)).where("value is not null").groupBy("game_pk", "field", "value").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.withColumn("term", F.when(F.col("field") == "clock", F.floor(F.col("value") / SLOT_MINUTES)).otherwise(F.col("value")))
    # one row of counts
    size = known.groupBy("game_pk").agg(F.count(F.lit(1)).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("dl")).first()
    n, mean = F.lit(float(size.n)), F.lit(float(size.dl or 1.0))
    df = tf.select("field", "term", "game_pk").distinct().groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    terms = tf.join(df.hint("merge"), ["field", "term"]).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    of = lambda f: F.collect_list(F.when(F.col("field") == f, F.struct(F.col("value").alias("at"), "tf", "idf")))
    # a game's attribute values are few: versions with equal values were counted above
    held = terms.groupBy("game_pk").agg(
        of("team").alias("teams"), of("day").alias("days"), of("clock").alias("starts"), of("number").alias("numbers"),
        F.sum(F.when(F.col("field") == "team", F.col("tf"))).alias("dl"), F.max(F.when(F.col("field") == "clock", F.col("value"))).alias("last_start"),
    )
    return held.select("game_pk", "teams", "days", "starts", "numbers", (K1 * (1 - B + B * F.col("dl") / 2 / mean)).alias("norm"), "last_start")


def _days_on(minute: F.Column) -> list[F.Column]:
    return [F.floor((minute - h * 60) / 1440) for h in (4, 8)]


def postings(index: DataFrame) -> DataFrame:
    """team, day, other, game_pk and the bounds a posting knows: one row per game, ordered pair of its teams, and day it has or may start on."""
    weight = lambda a, norm: bm25(a["tf"], a["idf"], norm)
    norm = F.col("norm")
    own = F.transform("days", lambda d: F.struct(d["at"].alias("day"), weight(d, norm).alias("by_day")))
    of_starts = F.transform(F.flatten(F.transform("starts", lambda s: F.array(*_days_on(s["at"])))), lambda d: F.struct(d.alias("day"), F.lit(0.0).alias("by_day")))
    pairs = F.filter(
        F.flatten(F.transform("teams", lambda a: F.transform("teams", lambda b: F.struct(a["at"].cast("int").alias("team"), b["at"].cast("int").alias("other"), (weight(a, norm) + weight(b, norm)).alias("by_team"))))),
        lambda p: p["team"] != p["other"],
    )
    most_idf = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: x["idf"])), F.lit(0.0))
    tops = index.select(
        "game_pk", "last_start", F.concat(own, of_starts).alias("on"), F.inline(pairs), (most_idf("starts") * (K1 + 1)).alias("clock_top"),
        (most_idf("numbers") * (K1 + 1)).alias("number_top"), F.coalesce(F.array_max(F.transform("days", lambda d: weight(d, norm))), F.lit(0.0)).alias("day_top"),
    )
    rows = tops.select("game_pk", "last_start", "team", "other", "by_team", "clock_top", "number_top", "day_top", F.inline("on"))
    keys = ["team", F.col("day").cast("int").alias("day"), "other", "game_pk"]
    return rows.groupBy(*keys).agg(F.max("by_day").alias("by_day"), *[F.first(c).alias(c) for c in ("by_team", "last_start", "clock_top", "number_top", "day_top")])


def _late(src, seen, last_start) -> F.Column:
    # exchanges list a game before it starts
    return F.when((src != "odds") & (seen > last_start + LATE_MINUTES), LATE).otherwise(1.0)


def candidates(records: DataFrame, index: DataFrame) -> DataFrame:
    """key, games: the games that can be among an event's best two, from the postings of (team, day) and their bounds.

    A pair of teams is sought by one of its teams, so an event gives one thin
    row per asked team and day; neither side of the join is ever broadcast.
    """
    asks = records.select("key", "src", "seen", F.inline("asks"), "wanted").select("key", "src", "seen", "team", "others", F.inline("wanted"))
    hits = (
        asks.hint("merge").join(postings(index).hint("merge"), ["team", "day"])
        .withColumn("pair", F.try_element_at("others", F.col("other")))
        .where("pair is not null")
    )
    late = _late(F.col("src"), F.col("seen"), F.col("last_start"))  # or not, if the day is named
    low = F.col("pair") * F.col("by_team") + F.col("weight") * F.col("by_day")
    # what the posting doesn't tell: the start, how near it is on the day, the number, another day of the game
    rest = F.col("clock") * F.col("clock_top") + F.col("number_top") + (1 + DAY_CLOSENESS) * F.col("day_top")
    each = hits.groupBy("key", "game_pk").agg(F.max(low * late).alias("low"), F.max(low + rest).alias("high"))
    # bounded by the games two teams play within the days an event may mean
    own = each.groupBy("key").agg(F.collect_list(F.struct("low", "high", "game_pk")).alias("c"))
    second = F.coalesce(F.try_element_at(F.sort_array(F.transform("c", lambda x: x["low"]), asc=False), F.lit(2)), F.lit(0.0))
    return own.select("key", F.transform(F.filter("c", lambda x: x["high"] >= second), lambda x: x["game_pk"]).alias("games"))


def retrieve(records: DataFrame, index: DataFrame) -> DataFrame:
    """key, src, game_pk, score, on_day: BM25 over all attributes of every candidate.

    on_day: a start lies within NEAR_MINUTES of one the game has had, or a day is an official day of the game.
    """
    asks = records.select("key", "src", "pairs", "starts", "days", F.col("number").alias("asked"), "seen").hint("merge")
    found = candidates(records, index).hint("merge").join(asks, "key").withColumn("game_pk", F.explode("games")).drop("games")
    g = index.select("game_pk", F.struct("teams", F.col("days").alias("on"), F.col("starts").alias("at"), "numbers", "norm", "last_start").alias("g")).hint("merge")
    both = found.hint("merge").join(g, "game_pk")
    norm = F.col("g.norm")
    weight = lambda a: bm25(a["tf"], a["idf"], norm)
    best = lambda c: F.coalesce(F.array_max(c), F.lit(0.0))
    team_of = lambda pair, k: F.split_part(pair, F.lit("-"), F.lit(k)).cast("bigint")
    team = lambda t: best(F.transform(F.filter("g.teams", lambda x: x["at"] == t), weight))
    named = F.filter("pairs", lambda p: F.exists("g.teams", lambda x: x["at"] == team_of(p["pair"], 1)) & F.exists("g.teams", lambda x: x["at"] == team_of(p["pair"], 2)))
    by_team = best(F.transform(named, lambda p: p["weight"] * (team(team_of(p["pair"], 1)) + team(team_of(p["pair"], 2)))))
    near = lambda m: F.filter("g.at", lambda v: F.abs(m - v["at"]) <= NEAR_MINUTES)
    # a start's term frequency: the versions that show it, each as much as it is near
    soft = lambda m: F.aggregate(near(m), F.lit(0.0), lambda a, v: a + v["tf"] * (1 - F.abs(m - v["at"]) / (2.0 * NEAR_MINUTES)))
    by_clock = best(F.transform("starts", lambda s: s["weight"] * bm25(soft(s["minute"]), best(F.transform(near(s["minute"]), lambda v: v["idf"])), norm)))
    off = F.array_min(F.flatten(F.transform("starts", lambda s: F.transform("g.at", lambda v: F.abs(s["minute"] - v["at"])))))
    close = DAY_CLOSENESS * F.greatest(F.lit(0.0), 1 - F.coalesce(off, F.lit(DAY_SCALE)) / float(DAY_SCALE))
    shifted = lambda d, v: F.when(d["day"] == v["at"], 1.0 + F.col("close")).when(F.abs(d["day"] - v["at"]) == 1, NEXT_DAY + F.col("close"))
    by_day = best(F.flatten(F.transform("days", lambda d: F.transform("g.on", lambda v: d["weight"] * weight(v) * F.coalesce(shifted(d, v), F.lit(0.0))))))
    named_day = F.arrays_overlap(F.transform("days", lambda d: d["day"].cast("bigint")), F.transform("g.on", lambda v: v["at"]))
    # the number is one of the day's games
    by_number = F.when(F.col("on_day"), best(F.transform(F.filter("g.numbers", lambda v: v["at"] == F.col("asked")), weight))).otherwise(0.0)
    parts = both.withColumn("close", close).withColumn("by_clock", by_clock).withColumn("named_day", named_day).withColumn("on_day", F.col("named_day") | (F.col("by_clock") > 0)).select("key", "src", "game_pk", "seen", F.col("g.last_start").alias("last_start"), by_team.alias("by_team"), "by_clock", "on_day", "named_day", by_day.alias("by_day"), by_number.alias("by_number"))
    late = F.when(F.col("named_day"), 1.0).otherwise(_late(F.col("src"), F.col("seen"), F.col("last_start")))
    score = (F.col("by_team") + F.col("by_clock") + F.col("by_day") + F.col("by_number")) * late
    return parts.where("by_team > 0 and by_clock + by_day > 0").select("key", "src", "game_pk", score.alias("score"), "on_day")


#: Sources that may list a game more than once.
REPEATING = ("odds",)


def best_games(scored: DataFrame) -> DataFrame:
    """key, src, game_pk, score, on_day, gap: each event's best game.

    ``gap`` is the lead over the second-best game, relative to the best score.
    """
    mine = scored.where("score > 0").groupBy("key", "src").agg(
        F.max_by(F.struct("game_pk", "score", "on_day"), F.struct("score", -F.col("game_pk"))).alias("top"),
        # bounded by the candidates of one event
        F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(2)).alias("next"),
    )
    return mine.select("key", "src", "top.*", ((F.col("top.score") - F.coalesce("next", F.lit(0.0))) / F.col("top.score")).alias("gap"))


def nearest_games(best: DataFrame) -> DataFrame:
    """key, src, game_pk, score, gap: the events of ``best_games`` that are their game's best event of that source too.

    Twins: in a source that may list a game twice, an event that isn't the
    game's best is kept too if it names both teams (all candidates do) and
    agrees with the game's day or one of its starts (``on_day``).  Nothing is
    ranked within a game: its best event comes from an aggregate that combines
    before the shuffle.
    """
    theirs = best.groupBy("game_pk", "src").agg(F.min_by("key", F.struct(-F.col("score"), "key")).alias("first"))
    placed = best.hint("merge").join(theirs.hint("merge"), ["game_pk", "src"])
    twin = F.col("src").isin(*REPEATING) & F.col("on_day")
    return placed.where(twin | (F.col("key") == F.col("first"))).select("key", "src", "game_pk", "score", "gap")


def calibrate(nearest: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve over the gap, fitted on all labelled events.

    Events are counted in GAP_BINS bins, so the fit sees every label and the
    driver a fixed number of rows.  A weak pull to a default curve, worth about
    one label, settles the fit where labels are few; without any, it is that curve.
    """
    binned = (
        nearest.hint("merge").join(labels, "key")
        .groupBy(F.least(F.floor(F.col("gap") * GAP_BINS), F.lit(GAP_BINS - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("game_pk") == F.col("label")).alias("k"))
        .collect()
    )
    w0, w1 = -0.5, 12.0
    prior0, prior1 = w0, w1
    for _ in range(50):  # Newton steps with a weak pull to the default curve
        g0 = g1 = h00 = h01 = h11 = 0.0
        for r in binned:
            x = (r.bin + 0.5) / GAP_BINS
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * x))))
            g0, g1 = g0 + r.k - r.n * p, g1 + (r.k - r.n * p) * x
            v = r.n * p * (1 - p)
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        g0, g1, h00, h11 = g0 - (w0 - prior0), g1 - 0.05 * (w1 - prior1), h00 + 1, h11 + 0.05
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        w0, w1 = w0 + d0, w1 + d1
        if abs(d0) + abs(d1) < 1e-9:
            break
    return w1, w0


def linked_events(odds: DataFrame, markets: DataFrame, polys: DataFrame, teams: DataFrame, games: DataFrame) -> DataFrame:
    """key, src, game_pk, confidence of every event that finds its game."""
    records = settled(event_records(odds, markets, polys, teams), "records")
    index = settled(game_index(games), "index")
    best = settled(best_games(retrieve(records, index)), "best")
    nearest = settled(nearest_games(best), "nearest")
    labels = (
        odds.where("game_pk is not null and id is not null")
        .groupBy(F.concat(F.lit("odds:"), "id").alias("key"))
        .agg(F.min("game_pk").alias("label"))
    )
    slope, intercept = calibrate(nearest, labels)
    confidence = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("gap"))))
    return nearest.select("key", "src", "game_pk", confidence.alias("confidence"))


def matched_pairs(odds: DataFrame, markets: DataFrame, polys: DataFrame, teams: DataFrame, games: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """key_a, key_b, confidence: events of two sources that stand for one game, key_a < key_b.

    The confidence is the product of both links'.  Events without both teams,
    of no game, or with a doubtful game give no row; null ids are left out.
    """
    linked = linked_events(odds, markets, polys, teams, games).where(F.col("confidence") >= accept)
    a, b = linked.alias("a").hint("merge"), linked.alias("b").hint("merge")
    pair = a.join(b, (F.col("a.game_pk") == F.col("b.game_pk")) & (F.col("a.src") < F.col("b.src")))
    return pair.select(
        F.least("a.key", "b.key").alias("key_a"), F.greatest("a.key", "b.key").alias("key_b"),
        (F.col("a.confidence") * F.col("b.confidence")).alias("confidence"),
    )

"""SQL that reads time texts as problem 1 asks; used by the queries' SQL only."""

from __future__ import annotations

_AB = "EDT|EST|CDT|CST|MDT|MST|PDT|PST|UTC|ET|CT|MT|PT"
_FORMS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p",
    "%b %d, %Y %I:%M:%S %p", "%Y-%m-%d", "%m/%d/%Y", "%Y%m%d", "%b %d, %Y",
)


def reading_sql(source: str) -> str:
    """Adds ``loc``, ``instant`` and the two readings ``early`` and ``late`` to rows of ``source`` (t, tz, ...)."""
    forms = ", ".join(f"'{f}'" for f in _FORMS)
    return rf"""
    (SELECT *, CASE WHEN timezone(zone, wall - INTERVAL 1 HOUR) = loc THEN wall - INTERVAL 1 HOUR ELSE wall END AS early, wall AS late FROM (
     SELECT *, timezone(zone, loc) AS wall FROM (
      SELECT *, CASE ab WHEN 'ET' THEN 'America/New_York' WHEN 'CT' THEN 'America/Chicago' WHEN 'MT' THEN 'America/Denver' WHEN 'PT' THEN 'America/Los_Angeles' ELSE tz END AS zone,
      CASE WHEN regexp_full_match(b, '\d{{10}}') THEN to_timestamp(CAST(b AS BIGINT))
           WHEN regexp_full_match(b, '\d{{13}}') THEN to_timestamp(CAST(b AS BIGINT) // 1000)
           WHEN regexp_full_match(b, '\d{{8}}T\d{{6}}Z') THEN timezone('UTC', try_strptime(b, '%Y%m%dT%H%M%SZ'))
           WHEN regexp_matches(b, '^[A-Z][a-z][a-z], ') THEN try_strptime(b, '%a, %d %b %Y %H:%M:%S %z')
           WHEN regexp_matches(iso, '^\d{{4}}-.*:.*(Z|[+-]\d\d:\d\d)$') THEN TRY_CAST(iso AS TIMESTAMPTZ)
           WHEN ab IN ('EDT', 'EST', 'CDT', 'CST', 'MDT', 'MST', 'PDT', 'PST', 'UTC') THEN timezone('UTC', loc + to_hours(
             CASE ab WHEN 'UTC' THEN 0 WHEN 'EDT' THEN 4 WHEN 'EST' THEN 5 WHEN 'CDT' THEN 5 WHEN 'CST' THEN 6 WHEN 'MDT' THEN 6 WHEN 'MST' THEN 7 WHEN 'PDT' THEN 7 ELSE 8 END)) END AS instant
      FROM (SELECT *, regexp_replace(regexp_replace(b, '\.\d+', ''), '([+-]\d\d)(\d\d)$', '\1:\2') AS iso, try_strptime(regexp_replace(b, '\.\d+', ''), [{forms}]) AS loc
       FROM (SELECT *, CASE WHEN regexp_matches(b1, '^\d{{4}}-\d\d-\d\dt') THEN upper(b1) ELSE b1 END AS b
        FROM (SELECT *, regexp_extract(trim(t), '\s({_AB})$', 1) AS ab, regexp_replace(trim(t), '\s({_AB})$', '') AS b1 FROM {source} WHERE t IS NOT NULL))))))"""


#: Hours of all payloads: rec_id, venue_id, pos, t, at.  A repeated wall clock's second entry is the later instant.
HOURS_SQL = f"""(SELECT rec_id, venue_id, pos, t, coalesce(instant, CASE WHEN row_number() OVER (PARTITION BY rec_id, loc ORDER BY pos) > 1 THEN late ELSE early END) AS at_ts
 FROM {reading_sql("(SELECT rec_id, venue_id, coalesce(timezone, 'UTC') AS tz, unnest(hourly.time) AS t, generate_subscripts(hourly.time, 1) - 1 AS pos FROM open_meteo)")})"""

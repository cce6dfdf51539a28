"""Questions as a table: their kind, what they name, and which answer they go to, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell kinds of questions apart, in the order in which the kinds are tried.
UNSUPPORTED = (
    "crane", "berth utilization", "berth productivity", "berth-level", "berth level", "berth queue", "teu", "teu throughput", "throughput", "gate queue", "queue length",
    "turn-time", "turn time", "truck turn-time", "truck turn time", "yard occupancy", "terminal gate", "container stack",
)
UNSUPPORTED_PATTERN = r"\bberth[\s-]*level\b|\bturn[\s-]*time\b|\bqueue[\s-]*length\b|\bgate[\s-]*queue\b|\bteu[\s-]*throughput\b"
CARBON = ("carbon", "emission", "emissions", "co2", "co2e", "nox", "sox", "pm", "tank-to-wake", "ttw", "well-to-wake", "wtw")
ANOMALY = ("anomaly", "unusual", "spike", "suspicious", "spoof", "jump", "impossible", "teleport")
FORECAST = ("forecast", "predict", "expected", "expect", "next", "coming", "future", "will")
COMPARE = ("compare", "vs", "versus", "more than", "less than", "which port")
DIAGNOSTIC = ("why", "cause", "reason", "dominated", "contributing", "contributors", "breakdown")
PATTERN = ("busiest", "usually", "pattern", "seasonal", "weekday", "day-of-week", "hour")
#: What a question measures, by the first row of which it has a word; else arrivals.
METRICS = (
    (("dwell",), "dwell_minutes"), (("congestion", "busy"), "congestion_index"), (("occupancy",), "occupancy_vessels"),
    (("arrival", "arrive"), "arrivals_vessels"), (("spike", "anomaly"), "arrivals_spike"),
)
VESSEL_WORDS = ((("tanker",), "tanker"), (("cargo",), "cargo ship"), (("container",), "container ship"))
WELL_TO_WAKE = ("wtw", "well-to-wake", "well to wake", "lifecycle", "co2e")
EXTREME, DATED = ("highest", "max", "peak"), ("day", "date")
#: Names of pollutants: words that may stand anywhere, words that stand by themselves.
POLLUTANTS = (("CO2e", ("co2e", "ghg"), ()), ("CO2", (), ("co2",)), ("NOx", ("nox",), ()), ("SOx", ("sox", "sulfur"), ()), ("PM", ("particulate",), ("pm",)))
UNNAMED = ("CO2e", "NOx", "SOx", "PM")
ASSUMED, PREDICTED, BY_MONTH = ("estimate", "assume", "scenario"), ("forecast", "predict"), ("monthly", "per month")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PORT_NAMES = ("gothenburg", "goteborg", "gdansk", "gdynia", "klaipeda", "riga", "kotka", "swinoujscie", "szczecin", "lubeck", "ventspils")
PORT_COUNTRIES = ("SE", "FI", "LV", "LT", "PL", "EE", "DK", "DE", "NO", "RU")
NO_PORT = (
    "TTW", "WTW", "CO2", "CO2E", "NOX", "SOX", "PM", "CARBON", "EMISSION", "EMISSIONS", "POLLUTANT", "POLLUTANTS", "GHG", "AIS", "IMO", "MMSI", "ETA", "UTC", "CSV", "RAG", "NIS2", "ISPS",
    "BASED", "PATTERNS", "EXPECTED", "PREDICT", "PREDICTED", "CONGESTION", "LIKELY", "WHICH", "SHOW", "SUSPICIOUS", "JUMPS", "MOVEMENT", "CHANGES", "HOUR", "HOURS", "KNOT", "KNOTS", "MODE",
    "DAILY", "TREND", "INDEX", "LEVEL", "ISTHE", "MONTHLY", "FOR", "WITH", *map(str.upper, MONTHS), *map(str.upper, DAYS),
)
NO_NAME = ("mmsi", "imo", "call", "call_id", "id", "the", "gate", "queue", "length", "turn", "time", "vessel", "ship", "tanker", "cargo", "container", "hours", "hour", "knots", "knot", "mode", "emissions", "emission", "co2", "co2e", "nox", "sox", "pm")
GENERIC = ("port", "index", "level", "daily", "trend", "monthly")


def _any(q: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(q, F.lit(w))
    return found


def unsupported(c: Column) -> Column:
    """Whether a question needs terminal data that neither positions nor port calls hold."""
    q = F.lower(c)
    return _any(q, UNSUPPORTED) | q.rlike(UNSUPPORTED_PATTERN)


def intent(c: Column) -> Column:
    """G unsupported, H emissions, F anomalies, C forecast, D comparison (B if of weekdays), E diagnosis, B pattern, A else."""
    q = F.lower(c)
    of_days = _any(q, (*DAYS, "weekend", "weekday"))
    return (
        F.when(unsupported(c), "G").when(_any(q, CARBON), "H").when(_any(q, ANOMALY), "F").when(_any(q, FORECAST), "C").when(_any(q, COMPARE) & of_days, "B").when(_any(q, COMPARE), "D")
        .when(_any(q, DIAGNOSTIC), "E").when(_any(q, PATTERN), "B").otherwise("A")
    )


def _first_of(c: Column, table: tuple[tuple[tuple[str, ...], str], ...]) -> Column:
    """The name of the first row of a table of words of which a question has one."""
    q = F.lower(c)
    return F.coalesce(*(F.when(_any(q, words), name) for words, name in table))


def metric(c: Column) -> Column:
    return F.coalesce(_first_of(c, METRICS), F.lit("arrivals_vessels"))


def aggregation(c: Column) -> Column:
    q = F.lower(c)
    return F.when(_any(q, EXTREME) & _any(q, DATED), "peak_day")


def vessel_type(c: Column) -> Column:
    return _first_of(c, VESSEL_WORDS)


def boundary(c: Column) -> Column:
    return F.coalesce(_first_of(c, ((WELL_TO_WAKE, "WTW"),)), F.lit("TTW"))


def pollutants(c: Column) -> Column:
    """The pollutants a question names, those of `UNNAMED` where it names none."""
    q = F.lower(c)
    alone = F.split(q, r"\W+")
    named = F.array_compact(F.array(*(F.when(_any(q, parts) | F.arrays_overlap(alone, F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")), name) for name, parts, words in POLLUTANTS)))
    return F.when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, UNNAMED)))


def weekdays(c: Column) -> Column:
    """The weekdays a question names, by their first places."""
    q = F.lower(c)
    found = F.array_compact(F.array(*(F.when(F.locate(d, q) > 0, F.struct(F.locate(d, q).alias("at"), F.lit(d.title()).alias("day"))) for d in DAYS)))
    return F.transform(F.array_sort(found), lambda x: x["day"])


def _first(q: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int")


def named_date(c: Column, today: Column) -> Column:
    """The one date a question names: an ISO date, a long date, or `this` or `next` weekday seen from `today`."""
    iso = F.regexp_extract_all(c, F.lit(r"\b(20\d{2}-\d{2}-\d{2})\b"), F.lit(1))
    months = "|".join(MONTHS)
    long = rf"(?i)\b({months})\s+(\d{{1,2}}),?\s+(20\d{{2}})\b"
    day = F.try_to_date(F.concat_ws("-", _first(c, long, 3), F.lpad(_month(_first(c, long, 1)).cast("string"), 2, "0"), F.lpad(_first(c, long, 2), 2, "0")), "yyyy-MM-dd")
    near = rf"(?i)\b(next|this)\s+({'|'.join(DAYS)})\b"
    ahead = F.pmod(F.array_position(F.array(*map(F.lit, DAYS)), F.lower(_first(c, near, 2))).cast("int") - 1 - F.weekday(today), F.lit(7))
    ahead = F.when((ahead == 0) & (F.lower(_first(c, near, 1)) == "next"), 7).otherwise(ahead)
    relative = F.when(_first(c, near, 2).isNotNull(), F.date_add(today, ahead))
    return F.coalesce(F.when(F.size(iso) == 1, F.try_to_date(F.get(iso, 0), "yyyy-MM-dd")), F.when(_first(c, long, 1).isNotNull(), day), relative)


def date_range(c: Column, today: Column) -> Column:
    """(start, end): two ISO dates in order, one, a named month, or the named date; nulls where there is none."""
    iso = F.transform(F.regexp_extract_all(c, F.lit(r"\b(20\d{2}-\d{2}-\d{2})\b"), F.lit(1)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    named, short = rf"(?i)\b({'|'.join(MONTHS)})\s+(20\d{{2}})\b", r"\b(20\d{2})-(0[1-9]|1[0-2])\b"
    first = F.coalesce(F.when(_first(c, named, 1).isNotNull(), F.make_date(_first(c, named, 2).cast("int"), _month(_first(c, named, 1)), F.lit(1))), F.when(_first(c, short, 1).isNotNull(), F.make_date(_first(c, short, 1).cast("int"), _first(c, short, 2).cast("int"), F.lit(1))))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    two = pair(F.least(F.get(iso, 0), F.get(iso, 1)), F.greatest(F.get(iso, 0), F.get(iso, 1)))
    one = named_date(c, today)
    weeks = c.rlike(r"(?i)\blast\s+\d{1,2}\s+weeks?\b")
    return F.when(F.size(iso) >= 2, two).when(F.size(iso) == 1, pair(F.get(iso, 0), F.get(iso, 0))).when(first.isNotNull(), pair(first, F.last_day(first))).when(weeks | one.isNull(), pair(one, one)).otherwise(pair(one, one))


def window(c: Column) -> Column:
    """`last_<n>_weeks` where a question asks for them and names neither a date nor a month."""
    n = _first(c, r"(?i)\blast\s+(\d{1,2})\s+weeks?\b")
    other = c.rlike(rf"(?i)\b20\d{{2}}-\d{{2}}-\d{{2}}\b|\b({'|'.join(MONTHS)})\s+20\d{{2}}\b|\b20\d{{2}}-(0[1-9]|1[0-2])\b")
    return F.when(~other & n.isNotNull(), F.concat(F.lit("last_"), n.cast("int").cast("string"), F.lit("_weeks")))


def horizon_weeks(c: Column) -> Column:
    """Weeks ahead, 1 to 12; 4 where none are named."""
    n = _first(F.lower(c), r"\b(\d{1,2})\s+weeks?\b").cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(12))).otherwise(4)


def _is_code(t: Column) -> Column:
    return t.rlike("^[A-Z]{5}$") & ~t.isin(*NO_PORT) & F.left(t, F.lit(2)).isin(*PORT_COUNTRIES)


def _cleaned(phrase: Column) -> Column:
    cut = F.get(F.split(F.trim(phrase, F.lit(" ,.;:()[]")), r"(?i)\b(?:between|from|on|during|next|last|this|for|with|where|when|which|in)\b", 2), 0)
    return F.trim(cut, F.lit(" ,.;:"))


def _is_name(p: Column) -> Column:
    low = F.lower(p)
    words = F.split(low, r"\s+")
    bad = F.arrays_overlap(words, F.array(*map(F.lit, NO_NAME)))
    return low.isin(*PORT_NAMES) | ((low != "") & ~low.isin(*GENERIC) & ~low.rlike(r"\d") & ~bad & (F.length(F.regexp_replace(low, r"\s", "")) >= 4))


def ports(c: Column) -> Column:
    """Up to four ports that a question names: codes, known names, then what follows `at`, `in`, `near`, `to`, `for`, `from`
    or stands between `between` and `and`."""
    tight = lambda x: F.replace(F.upper(x), F.lit(" "), F.lit(""))
    codes = F.filter(F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"\b([A-Z]{2}\s?[A-Z]{3})\b"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s", "")), _is_code)
    words = F.regexp_extract_all(c, F.lit(r"\b([A-Za-z]{4,})\b"), F.lit(1))
    single = F.filter(F.transform(words, lambda w: F.when(_is_code(F.upper(w)), F.upper(w)).when(F.lower(w).isin(*PORT_NAMES), w)), lambda x: x.isNotNull())
    after = F.regexp_extract_all(c, F.lit(r"(?i)\b(?:at|in|near|to|for|from)\s+([A-Za-z][A-Za-z\- ]{2,48})"), F.lit(1))
    between = r"(?i)\bbetween\s+([A-Za-z0-9\- ]{2,24})\s+and\s+([A-Za-z0-9\- ]{2,24})"
    both = F.concat(after, F.regexp_extract_all(c, F.lit(between), F.lit(1)), F.regexp_extract_all(c, F.lit(between), F.lit(2)))
    phrases = F.filter(F.transform(F.transform(both, _cleaned), lambda p: F.when(_is_code(tight(p)), tight(p)).when(_is_name(p), p)), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(codes, single, phrases)), 1, 4)


def carbon_route(c: Column) -> Column:
    """The emission answer of a question: a call, an estimate, a forecast, or a port (by month if it asks for that)."""
    q = F.lower(c)
    call = _first(c, r"(?i)\bcall[_\-\s]?id[\s:=_\-]*([A-Za-z0-9_\-:.]+)\b").isNotNull()
    assumed = _any(q, ASSUMED) & q.rlike(r"\d+(\.\d+)?\s*(h|hours?|kn|knots?)\b")
    return F.when(call, "call").when(assumed, "estimate").when(_any(q, ("forecast", "predict")), "forecast_only").when(_any(q, BY_MONTH), "port_by_month").otherwise("port_by_day")


def understood(questions: DataFrame, today: Column) -> DataFrame:
    """`questions(question)` with the kind of each and the entities it names."""
    c = F.col("question")
    days, found = weekdays(c), ports(c)
    special = F.when(F.lower(c).contains("weekend"), "Weekend").when(F.lower(c).contains("weekday"), "Weekday")
    span = date_range(c, today)
    return questions.select(
        "*", intent(c).alias("intent"), metric(c).alias("metric"), aggregation(c).alias("aggregation"), vessel_type(c).alias("vessel_type"), F.array_join(found, ",").alias("ports"), F.get(found, 0).alias("port"),
        F.coalesce(F.get(days, 0), special).alias("dow"), F.get(days, 1).alias("dow_compare"), span["start"].alias("date_from"), span["end"].alias("date_to"), named_date(c, today).alias("target_date"),
        window(c).alias("window"), horizon_weeks(c).alias("horizon_weeks"), boundary(c).alias("boundary"), F.array_join(pollutants(c), ",").alias("pollutants"),
        _first(c, r"(?i)\bmmsi\s*[:#]?\s*(\d{6,9})\b").alias("mmsi"), _first(c, r"(?i)\bimo\s*[:#]?\s*(\d{6,8})\b").alias("imo"),
        F.nullif(F.regexp_replace(_first(c, r"(?i)\bcall[_\-\s]?id[\s:=_\-]*([A-Za-z0-9_\-:.]+)\b"), r"^[\s:_\-]+", ""), F.lit("")).alias("call_id"), F.when(intent(c) == "H", carbon_route(c)).alias("carbon_route"),
    )

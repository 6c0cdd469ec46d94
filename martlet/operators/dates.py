"""CLN-10: dates in text, by a census of the texts' shapes.

A column of text holds few shapes of dates however many rows it has. Each text
is mapped to its shape (digits to ``0``, month names to ``B``, week days to ``W``,
am and pm to ``P``); the shapes of all text columns are counted in one pass,
combined on the map side, and those that can be dates come to the driver: the
grammar below allows a fixed number of them, whatever the data hold. Each found
shape is parsed once into a plan, the places of year, month, day, time and
offset among the text's numbers. Rows then look their shape's plan up in a
literal map and assemble an ISO text, which Spark's cast checks; no formatter
and no Python runs per row.

Rules, as pandas' ``format="mixed"`` has them: of two small numbers the first is
the month unless it is above 12 and the second isn't; years of two digits lie
within 50 years of this one; a month without a day is its first; a text with an
offset (``Z``, ``+02:00``) is an instant, given as its UTC time. With
``day_first="evidence"`` the census also decides the order of such numbers per
column: day first where some first number is above 12 and no second one is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names, and the letters that may stand in a date.
_MONTHS = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
           "|nov(?:ember)?|dec(?:ember)?")
_DAYS = "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"
LONGEST = 64

# Shapes of the date part -> the order of its numbers; M is the month's name.
_ONE, _YEAR, _ORD = "00?", "0000", "(?:st|nd|rd|th)?"
_GAP, _IN = "(?:[., ]+)", "(?:[-., /]+)"
_DATES = (
    (rf"{_YEAR}[-/. ]{_ONE}[-/. ]{_ONE}", "ymd"), (rf"{_YEAR}[-/]{_ONE}", "ym"), (_YEAR, "y"),
    (rf"{_ONE}[-/. ]{_ONE}[-/. ](?:{_YEAR}|00)", "mdy"),
    (rf"(?:W{_GAP})?B{_GAP}{_ONE}{_ORD}{_GAP}(?:{_YEAR}|00)", "Mdy"),
    (rf"(?:W{_GAP})?{_ONE}{_ORD}{_IN}B{_IN}(?:{_YEAR}|00)", "dMy"),
    (rf"B{_IN}{_YEAR}", "My"), (rf"{_YEAR}{_IN}B{_IN}{_ONE}", "yMd"),
)
_TIME = r"(?:(?:t|,? )(?P<clock>00?:00?(?::00?(?:\.0{1,9})?)?)(?: ?P)?(?P<offset> ?(?:z|utc|gmt|[+-]00(?::00)?))?|,? (?P<hour>00?) ?P)?"
_GRAMMAR = tuple((re.compile(f"(?P<date>{d}){_TIME if len(order) > 2 else ''}"), order) for d, order in _DATES)
#: The same as one pattern without names, for Spark.
SHAPES = "^(?:" + "|".join(re.sub(r"\?P<\w+>", "?:", g.pattern) for g, _ in _GRAMMAR) + ")$"


def normal(c: Column) -> Column:
    """Trimmed lower-case text in which runs of digits without separators
    (``20240506T101112``) are taken apart; null if it can't be a date."""
    trimmed = F.trim(c)
    t = F.lower(trimmed)
    taken = F.regexp_replace(t, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?=$|[t ][0-9]|[0-9]{4}(?:[0-9]{2})?$)", "$1-$2-$3 ")
    taken = F.regexp_replace(taken, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) [t ]?([0-9]{2})([0-9]{2})([0-9]{2})?(?![0-9:])", "$1 $2:$3:$4")
    taken = F.regexp_replace(F.regexp_replace(F.rtrim(taken), ":$", ""), "^([0-9]{4}-[0-9]{2}-[0-9]{2}) [t ](?=[0-9])", "$1 ")
    offset = "(:[0-9.]+ ?[+-][0-9]{2})([0-9]{2})$"
    possible = (F.length(c) <= 2 * LONGEST) & trimmed.rlike(rf"^(?=.*[0-9])[0-9A-Za-z ,./:+-]{{4,{LONGEST}}}$")
    return F.when(possible, F.when(trimmed.rlike("^[0-9]{8}"), taken).when(
        trimmed.rlike(offset), F.regexp_replace(t, offset, "$1:$2")).otherwise(t))


def raw_shape(n: Column) -> Column:
    """The shape of a ``normal`` text, whether or not it can be a date's."""
    s = F.translate(n, "123456789", "000000000")
    named = F.regexp_replace(s, rf"\b(?:{_MONTHS})(?:\b|(?=0))\.?", "B")
    named = F.regexp_replace(F.regexp_replace(named, rf"\b(?:{_DAYS})\b\.?", "W"), r"(?<![a-z])[ap]\.?m\.?$", "P")
    return F.when(n.rlike("[a-z]"), named).otherwise(s)


def shape(n: Column) -> Column:
    """The shape of a ``normal`` text; null if some word has no place in a date."""
    s = raw_shape(n)
    return F.when(s.rlike(SHAPES), s)


def numbers(n: Column) -> Column:
    return F.regexp_extract_all(n, F.lit("[0-9]+"), F.lit(0))


@dataclass(frozen=True)
class Plan:
    """Places of a shape's parts among its numbers (-1: none)."""
    year: int
    month: int
    day: int
    hour: int
    minute: int
    second: int
    fraction: int
    offset_hour: int
    offset_minute: int
    two_digits: bool  # the year
    ambiguous: bool  # month and day are told apart by their values
    named: bool  # the month
    half: bool  # am or pm


def plan_of(text_shape: str) -> Plan | None:
    """The plan of a shape; None if it is no date."""
    for pattern, order in _GRAMMAR:
        m = pattern.fullmatch(text_shape)
        if not m:
            continue
        parts = [p for p in order if p != "M"]
        at = {p: i for i, p in enumerate(parts)}
        k = len(parts)
        groups = m.groupdict()
        clock, offset, hour = groups.get("clock"), groups.get("offset") or "", groups.get("hour")
        sizes = [len(x) for x in re.split(r"[:.]", clock)] if clock else [len(hour)] if hour else []
        places = [k + i if i < len(sizes) else -1 for i in range(4)]
        k += len(sizes)
        numbers = offset.count("0") // 2
        date = [len(x) for x in re.findall("0+", m["date"])]
        return Plan(at["y"], at.get("m", -1), at.get("d", -1), *places, k if numbers else -1, k + 1 if numbers > 1 else -1,
                    date[at["y"]] == 2, order == "mdy", "M" in order, text_shape.endswith("P") or " P" in text_shape)
    return None


def _wanted(columns: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(c).alias("t")) for i, c in enumerate(columns)]))


def census(df: DataFrame, columns: dict[str, Column]) -> dict[str, dict[str, dict]]:
    """For each named text column the shapes that can be dates: ``n`` texts, and
    the largest first and second number (``a``, ``b``). One pass over all."""
    if not columns:
        return {}
    names = list(columns)
    texts = df.select(*[normal(c).alias(f"t{i}") for i, c in enumerate(columns.values())])
    cells = texts.select(_wanted([f"t{i}" for i in range(len(names))]).alias("e")).select("e.*").where("t IS NOT NULL")
    seen = cells.select("ci", raw_shape(F.col("t")).alias("shape"), numbers(F.col("t")).alias("x"))
    seen = seen.where(F.col("shape").rlike("^[0BWPtzucgmsndrh ,./:+-]+$"))
    small = lambda k: F.max(F.get("x", F.lit(k)).try_cast("int"))
    counted = seen.groupBy("ci", "shape").agg(F.count(F.lit(1)).alias("n"), small(0).alias("a"), small(1).alias("b"))
    rows = counted.where(F.col("shape").rlike(SHAPES)).collect()
    out: dict[str, dict[str, dict]] = {n: {} for n in names}
    for r in rows:
        out[names[r["ci"]]][r["shape"]] = {"n": r["n"], "a": r["a"], "b": r["b"]}
    return out


def plans_of(shapes: dict[str, dict]) -> dict[str, Plan]:
    """Plans of a column's shapes, the commonest first."""
    found = {s: plan_of(s) for s in sorted(shapes, key=lambda s: (-shapes[s]["n"], s))}
    return {s: p for s, p in found.items() if p}


def day_comes_first(shapes: dict[str, dict]) -> bool:
    """Evidence of the column: a first number above 12, and no second one."""
    both = [(v["a"], v["b"]) for s, v in shapes.items() if (p := plan_of(s)) and p.ambiguous]
    return any(12 < a <= 31 for a, _ in both) and not any(b > 12 for _, b in both)


def _places(s: Column, x: Column) -> Column:
    """The parts of a ``Plan`` worked out for each row's shape, for columns
    without a census: places, whether the year has two digits, whether month and
    day are told apart by their values."""
    offset = F.regexp_extract(s, "(?::[0.:]+(?: ?P)?)( ?[+-]00(?::00)?)$", 1)
    n_offset = F.regexp_count(offset, F.lit("00"))
    out = F.lit(None).cast("array<int>")
    for pattern, order in reversed(_GRAMMAR):
        parts = [p for p in order if p != "M"]
        at, k = {p: i for i, p in enumerate(parts)}, len(parts)
        clock = F.size(x) - k - n_offset
        rest = [F.when(clock > i, k + i).otherwise(-1) for i in range(4)]
        rest += [F.when(n_offset > i, k + clock + i).otherwise(-1) for i in range(2)]
        short = (F.length(F.get(x, F.lit(at["y"]))) == 2).cast("int")
        places = F.array(*[F.lit(at.get(p, -1)) for p in "ymd"], *rest, short, F.lit(int(order == "mdy")))
        out = F.when(s.rlike("^" + re.sub(r"\?P<\w+>", "?:", pattern.pattern) + "$"), places).otherwise(out)
    return out


def parse(c: Column, plans: dict[str, Plan] | None, day_first: bool = False, this_year: Column | None = None) -> Column:
    """Zone-less timestamp of text whose shape has a plan (None: any shape of
    the grammar); else null. ``prepared`` does the same over many columns without
    working anything out twice."""
    def once(x: Column, use) -> Column:
        return F.get(F.transform(F.array(x), use), F.lit(0))

    if plans is None:
        return once(normal(c), lambda n: once(
            F.struct(n.alias("t"), shape(n).alias("s"), numbers(n).alias("x")), lambda v: once(
                F.struct(v["t"].alias("t"), v["x"].alias("x"), _places(v["s"], v["x"]).alias("p")),
                lambda w: _assemble(w, day_first, this_year))))
    return once(normal(c), lambda n: once(F.struct(n.alias("n"), raw_shape(n).alias("s"), numbers(n).alias("x")),
                                          lambda v: by_plan(v["n"], v["s"], v["x"], plans, day_first, this_year)))


def prepared(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``n, s, x`` of each named text column (``__n_name`` ...), in
    projections of their own, for ``of_prepared``."""
    out = df.select("*", *[normal(c).alias(f"__n_{k}") for k, c in columns.items()])
    return out.select("*", *[raw_shape(F.col(f"`__n_{k}`")).alias(f"__s_{k}") for k in columns],
                      *[numbers(F.col(f"`__n_{k}`")).alias(f"__x_{k}") for k in columns])


def of_prepared(name: str, plans: dict[str, Plan], day_first: bool = False) -> Column:
    return by_plan(*[F.col(f"`__{part}_{name}`") for part in "nsx"], plans, day_first)


def by_plan(n: Column, s: Column, x: Column, plans: dict[str, Plan], day_first: bool = False,
            this_year: Column | None = None) -> Column:
    """The timestamp from a text's shape and numbers: each plan is an expression
    of just what its shape needs."""
    out = None
    for text_shape, plan in plans.items():
        value = _by(plan, n, x, day_first, this_year)
        out = F.when(s == text_shape, value) if out is None else out.when(s == text_shape, value)
    return F.lit(None).cast("timestamp_ntz") if out is None else out


def _two_digit_year(short: Column, this_year: Column | None) -> Column:
    now = F.year(F.current_date()) if this_year is None else this_year
    near = short + F.floor(now / 100).cast("int") * 100
    return F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)


def _month_number(n: Column) -> Column:
    name = F.regexp_extract(n, f"({_MONTHS})", 1)
    return ((F.instr(F.lit(_ORDER), F.substring(name, 1, 3)) + 2) / 3).cast("int")


def _by(plan: Plan, n: Column, x: Column, day_first: bool, this_year: Column | None) -> Column:
    at = lambda k: F.get(x, F.lit(k))
    number = lambda k: at(k).try_cast("int")
    year = _two_digit_year(number(plan.year), this_year).cast("string") if plan.two_digits else at(plan.year)
    month = _month_number(n).cast("string") if plan.named else at(plan.month) if plan.month >= 0 else F.lit("1")
    day = at(plan.day) if plan.day >= 0 else F.lit("1")
    if plan.ambiguous:
        a, b = number(plan.month), number(plan.day)
        swapped = (b <= 12) if day_first else (a > 12) & (b <= 12)
        month, day = F.when(swapped, day).otherwise(month), F.when(swapped, month).otherwise(day)
    iso = [year, F.lit("-"), month, F.lit("-"), day]
    if plan.hour >= 0:
        hour = at(plan.hour)
        if plan.half:
            h = number(plan.hour)
            hour = F.when(h.between(1, 12), h % 12 + F.when(n.rlike(r"p\.?m\.?"), 12).otherwise(0)).otherwise(99).cast("string")
        iso += [F.lit(" "), hour, F.lit(":"), at(plan.minute) if plan.minute >= 0 else F.lit("0"), F.lit(":"),
                at(plan.second) if plan.second >= 0 else F.lit("0")]
        if plan.fraction >= 0:
            iso += [F.lit("."), at(plan.fraction)]
    out = F.concat(*iso).try_cast("timestamp_ntz")
    if plan.offset_hour >= 0:
        minutes = number(plan.offset_hour) * 60 + (number(plan.offset_minute) if plan.offset_minute >= 0 else F.lit(0))
        out = out - F.make_dt_interval(mins=F.when(n.rlike(r":[0-9.]+ ?-[0-9:]+$"), -minutes).otherwise(minutes))
    return out


def _assemble(v: Column, day_first: bool, this_year: Column | None) -> Column:
    x, p, t = v["x"], v["p"], v["t"]

    def text(k: int, missing: str) -> Column:
        return F.when(F.get(p, F.lit(k)) >= 0, F.get(x, F.get(p, F.lit(k)))).otherwise(F.lit(missing))

    def number(k: int, missing: int) -> Column:
        return text(k, str(missing)).try_cast("int")

    named = F.when(t.rlike(_MONTHS), _month_number(t))
    a, b = number(1, 1), number(2, 1)
    month = F.when(F.get(p, F.lit(1)) >= 0, a).otherwise(F.coalesce(named, F.lit(1)))
    swapped = F.get(p, F.lit(10)) == 1
    swapped = swapped & ((b <= 12) if day_first else ((a > 12) & (b <= 12)))
    month, day = F.when(swapped, b).otherwise(month), F.when(swapped, a).otherwise(b)
    short = number(0, 0)
    year = F.when(F.get(p, F.lit(9)) == 1, _two_digit_year(short, this_year)).otherwise(short)
    half = F.regexp_extract(t, r"([ap])\.?m\.?$", 1)
    hour = number(3, 0)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    iso = F.concat_ws("", F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
                      F.lpad(day.cast("string"), 2, "0"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"),
                      F.lpad(text(4, "0"), 2, "0"), F.lit(":"), F.lpad(text(5, "0"), 2, "0"), F.lit("."), text(6, "0"))
    at = iso.try_cast("timestamp_ntz")
    minutes = number(7, 0) * 60 + number(8, 0)
    minutes = F.when(t.rlike(r":[0-9.]+ ?-[0-9:]+$"), -minutes).otherwise(minutes)
    at = F.when(F.get(p, F.lit(7)) >= 0, at - F.make_dt_interval(mins=minutes)).otherwise(at)
    return F.when(p.isNotNull(), at)

"""What a page row's normalised text says: results, intervals, roles of dates, events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Formats of numbers, intervals and units in a row, words of panel
# rows and reference fields, longest rows, and other spellings of a unit.
NUMBER = r"\d+(?:\.\d+)?"
INTERVAL = rf"{NUMBER}\s*[-–—]\s*{NUMBER}"
SIGNED = r"(?:<=|>=|[<>≤≥])?[+-]?"
RESULT = rf"(?U)(?<![\w.]){SIGNED}{NUMBER}(?![\w.])"
RESULT_WITH_STOP = rf"(?U)(?<![\w.]){SIGNED}\d+\.(?=\s|$)"
UNIT_LETTERS = "a-zа-яіїєґ"
UNIT = rf"[{UNIT_LETTERS}µμ%]+[{UNIT_LETTERS}0-9^*]*/[{UNIT_LETTERS}0-9^*.]+|%"
PANEL = r"(?U)\b(?:your result|test status|reference range|reference interval)\b"
REFERENCE_FIELD = r"(?U)\b(?:reference|ref|norm|normal|referencia|референс|норма)\b"
PHONE = r"\d{3}-\d{3}-\d{4}"
LONGEST_ROW, LONGEST_PANEL, LONGEST_ASIDE = 120, 260, 48
UNIT_ALIASES = {"ug/l": ("ugn", "ug/l", "µg/l", "mcg/l")}
# What tells the role of a date, in the order in which ties fall.
ROLE_CUES = {
    "specimen": ("specimen", "collected", "collection", "drawn", "забор", "взят", "взяті", "зразок"),
    "report": ("report", "issued", "received", "printed", "reported", "видано", "видан", "результат"),
}
BIRTH = r"(?U)\b(?:date\s+of\s+birth|dob|born|birthday|дата\s+рожд|рождения|рожденн|дата\s+народж)\b"
PRINTED = r"(?U)\b(?:printed|issued|reported|report)\b"
STATED_DATE = r"\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}-\d{2}-\d{2}"
# Cues of event types, what negates and what cancels a clause, and
# the kinds of documents that speak of an event directly.
EVENT_CUES = {
    "recommendation": "рекоменд recommend порад",
    "referral": "направлен направля referral referred refer_to направл",
    "appointment_scheduled": "запис scheduled booked заплан призначен назначен",
    "appointment_confirmed": "подтвержд підтверд confirmed",
    "encounter": "консультац consultation прием приём прийом осмотр огляд visit examin",
    "procedure": "процедур операци біопс биопс procedure biopsy surgery",
    "result": "заключен висновок result ultrasound узи узд mri мрт",
    "discharge": "выписк виписк discharge",
    "invoice": "счет рахунок invoice receipt bill",
}
NEGATION = r"(?U)(?:^|\s)(?:no|not|never|denied|without|neither|nor|не|нет|ні|ни|без|відсут)(?:\s|$)"
CANCELLATION = r"(?U)cancel|postpon|reschedul|no[\s-]?show|did\s+not\s+attend|отмен|скасов|перенес|не\s+(?:состоял|відбул|явил|з'явив)"
LEADING = ("referral", "appointment_scheduled", "appointment_confirmed")
LED = ("encounter", "procedure", "result")
DIRECT = {
    "referral": "referral", "appointment_scheduled": "appointment", "appointment_confirmed": "appointment", "encounter": "visit_note", "procedure": "visit_note discharge",
    "result": "imaging_report lab_report visit_note", "discharge": "discharge", "invoice": "invoice", "other": "visit_note discharge referral",
}


def has_token(text: Column, needle: Column) -> Column:
    """Whether a needle that is not empty stands in the text on its own."""
    return F.coalesce((F.length(needle) > 0) & T.contains_token(text, needle), F.lit(False))


def handle(needle: Column) -> Column:
    """The longest run of word characters of a text: every text that holds the
    needle as a token holds this run as one. A mark for needles without any."""
    runs = F.transform(word_runs(needle), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.coalesce(F.array_max(runs)["r"], F.lit("\0"))


def word_runs(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def unit_like(text: Column) -> Column:
    """Whether something like a unit stands in the text."""
    return text.rlike(UNIT)


def is_result_row(text: Column) -> Column:
    """Whether a row reads like one of a table of results: it begins with a word,
    has a number of its own, and a unit or an interval. Rows of panels may be
    longer and begin otherwise; intervals in running text are none."""
    rest = F.regexp_replace(text, INTERVAL, " ")
    panel, interval, unit = text.rlike(PANEL), text.rlike(INTERVAL), unit_like(rest)
    number = rest.rlike(RESULT) | rest.rlike(RESULT_WITH_STOP)
    before, after = (F.regexp_extract(text, rf"^(.*?){INTERVAL}(.*)$", i) for i in (1, 2))
    aside = (F.length(F.trim(before)) <= LONGEST_ASIDE) & (F.length(F.trim(after)) <= LONGEST_ASIDE)
    alone = interval & aside & ~text.rlike(PHONE) & ~before.rlike(r"(?U)\b(?:in|about|per)\b")
    fits = F.length(text) <= F.when(panel, LONGEST_PANEL).otherwise(LONGEST_ROW)
    named = rest.rlike(r"(?U)^\W*\p{L}{3,}")
    return F.coalesce(fits & number & F.when(panel, unit | interval).otherwise(named & (unit | alone)), F.lit(False))


def result_at(text: Column, label: Column, value: Column) -> Column:
    """Whether ``value`` is the first result right of the label, intervals aside.

    Comparator and sign belong to the result. Where no number stands and none is
    claimed, what stands before a bar or a reference field is compared."""
    after = F.substring(text, F.instr(text, label) + F.length(label), F.length(text))
    rest = F.regexp_replace(after, INTERVAL, " ")
    number = F.coalesce(F.nullif(F.regexp_extract(rest, f"({RESULT})", 1), F.lit("")), F.regexp_replace(F.nullif(F.regexp_extract(rest, f"({RESULT_WITH_STOP})", 1), F.lit("")), r"\.$", ""))
    field = F.regexp_extract(F.regexp_replace(after, rf"{REFERENCE_FIELD}.*$", ""), r"^[ :;,.|]*([^|]*)", 1)
    words = F.regexp_replace(field, r"^[ :;,.|]+|[ :;,.|]+$", "")
    found = F.when(number.isNotNull(), T.edges(number) == value).otherwise(~value.rlike(r"\d") & (words == value))
    return F.coalesce(has_token(text, label) & (F.length(value) > 0) & found, F.lit(False))


def spans_with(parts: Column, members: Column, needle: Column) -> Column:
    """Spans of a row that carry the needle: those that hold it, else those that
    stand in it, else all."""
    pick = lambda keep: F.transform(F.filter(parts, keep), lambda p: p["i"])
    whole = pick(lambda p: has_token(p["t"], needle))
    inside = pick(lambda p: (F.length(p["t"]) > 0) & F.contains(needle, p["t"]))
    return F.when(F.size(whole) > 0, whole).when(F.size(inside) > 0, inside).otherwise(members)


def role_before(text: Column, date: Column) -> Column:
    """The role whose cue ends last before the date in the text, if any."""
    table = [(cue[::-1], -i, role) for i, (role, cue) in enumerate((r, c) for r, cues in ROLE_CUES.items() for c in cues)]
    cues = F.array(*[F.struct(F.lit(back).alias("back"), F.lit(rank).alias("rank"), F.lit(role).alias("role")) for back, rank, role in table])

    def of(ahead: Column) -> Column:
        back = F.reverse(ahead)
        seen = F.filter(cues, lambda c: F.contains(back, c["back"]))
        # the nearer the cue's end, the fewer letters lie behind it
        return F.array_max(F.transform(seen, lambda c: F.struct((-F.position(c["back"], back)).alias("end"), c["rank"].alias("rank"), c["role"].alias("role"))))["role"]

    at = F.instr(text, date)
    return T.let(F.when((F.length(date) > 0) & (at > 0), F.substring(text, F.lit(1), at - 1)), of)


def states_other_date(text: Column, date: Column) -> Column:
    """Whether a date in numbers stands in the text that is not this one."""
    return F.exists(F.regexp_extract_all(text, F.lit(STATED_DATE), F.lit(0)), lambda d: T.edges(d) != date)


def has_other_words(text: Column, date: Column) -> Column:
    """Whether the row has words besides the date."""
    at = F.instr(text, date)
    rest = F.when((F.length(date) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(date), F.length(text)))).otherwise(text)
    return rest.rlike(r"\p{L}")


def wording_types(wording: Column) -> Column:
    """Event types a wording implies, in alphabetical order.

    The clauses are folded: one that negates or cancels takes its own types back,
    or all that came before when it only cancels; others add theirs. A
    recommendation leaves only ``other``; referrals and appointments hide the
    encounter, procedure or result they lead to. Null implies nothing."""
    clauses = F.filter(F.split(T.normalise(wording), r"[.;!?]+"), lambda c: F.trim(c) != "")
    none = F.array().cast("array<string>")

    def told(clause: Column) -> Column:
        return F.array_compact(F.array(*[F.when(clause.rlike("|".join(cues.replace("_", " ") for cues in words.split())), F.lit(t)) for t, words in EVENT_CUES.items()]))

    def fold(types: Column, clause: Column) -> Column:
        own = told(clause)
        cancelled = clause.rlike(CANCELLATION)
        back = F.when(F.size(own) > 0, F.array_except(types, own)).when(cancelled, none).otherwise(types)
        return F.when(cancelled | clause.rlike(NEGATION), back).otherwise(F.array_union(types, own))

    types = F.aggregate(F.coalesce(clauses, none), none, fold)
    quiet = F.when(F.arrays_overlap(types, F.array(*[F.lit(t) for t in LEADING])), F.array_except(types, F.array(*[F.lit(t) for t in LED]))).otherwise(types)
    return F.array_sort(F.when(F.array_contains(types, "recommendation"), F.array(F.lit("other"))).otherwise(quiet))


def evidence_strength(handwriting: Column, verified: Column, types: Column, event_type: Column, document_class: Column) -> Column:
    """``weak``, ``indirect`` or ``direct`` support of an event; ``types`` are those
    its wording implies."""
    direct = F.lit(False)
    for t, classes in DIRECT.items():
        direct = direct | ((event_type == t) & document_class.isin(classes.split()))
    other = (F.size(types) > 0) & ~F.array_contains(types, event_type)
    return F.when(handwriting, "weak").when(~verified | F.coalesce(other, F.lit(False)), "indirect").when(F.coalesce(direct, F.lit(False)), "direct").otherwise("indirect")

"""Text rules: normal form, circular payers, thesis keys, leaks of private metrics, routes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewick.functions.scalar import nearest_bucket

#: Words without weight, and words that name nobody.
STOP_WORDS = ("o", "a", "os", "as", "de", "do", "da", "dos", "das", "e", "em", "no", "na", "nos", "nas", "que", "por", "pelo", "pela", "um", "uma", "the")
GENERIC = (
    "mercado", "mercados", "trader", "traders", "reversao", "reversoes", "tendencia", "tendencias", "investidor", "investidores", "participante", "participantes", "geral", "todos", "alguem",
    "agente", "agentes", "players", "player",
)
#: Words and field names that must not leave.
METRIC_WORDS = ("sharpe", "pnl", "drawdown", "sortino", "kurtosis", "deflated")
METRIC_FIELDS = ("test_id", "path_id", "n_trades", "gross_pnl_points", "cost_points", "net_pnl_points", "max_dd_points", "hit_rate", "avg_holding_s", "max_day_share", "active_days", "rejected_orders")


def _forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form holds ASCII letters or digits: those that become one of them, what they become, and those that become more than one character.

    Marks go, and so does what is neither; letters are lower-cased first, here as in the text.
    """
    have, want, longer = [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1AD), *range(0x1FBF0, 0x1FBFA)):
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        if c == d or not any(x.isascii() and x.isalnum() for x in d):
            continue
        if len(d) == 1:
            have.append(c)
            want.append(d)
        else:
            longer[c] = d
    return "".join(have), "".join(want), longer


def normalized(text: Column) -> Column:
    """Lower case without accents, compatibility forms as what they stand for; words of a-z and 0-9 joined by single spaces."""
    have, want, longer = _forms()
    plain = F.translate(F.lower(text), have, want)
    # Characters that stand for several are rare: a text without one is left alone, in another its characters are looked up one by one.
    table = F.map_from_arrays(F.array(*map(F.lit, longer)), F.array(*map(F.lit, longer.values())))
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    plain = F.when(F.regexp_like(plain, F.lit("[" + "".join(longer) + "]")), spelled).otherwise(plain)
    plain = F.regexp_replace(plain, "\\p{Mn}", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def circular(who: Column) -> Column:
    words = F.filter(F.split(normalized(who), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.forall(words, lambda w: w.isin(*GENERIC))


def semantic_key(family: Column, observable: Column, direction: Column, horizon_min: Column) -> Column:
    return F.concat_ws("|", family, normalized(observable), direction, nearest_bucket(F.greatest(horizon_min, F.lit(1))).cast("string"))


def metric_word(text: Column) -> Column:
    """The text names a private metric."""
    return F.lower(text).rlike("|".join((*METRIC_WORDS, *METRIC_FIELDS)))


def number_forms(v: Column) -> Column:
    """How a private number may be written: as it is, without an exponent, with 2, 3 and up to 4 decimals; whole numbers from 1000 on; numbers that are not finite, not at all."""
    a = F.abs(v.cast("double"))
    plain = F.regexp_replace(a.cast("string").try_cast("decimal(38,18)").cast("string"), "\\.?0+$", "")
    fixed = [F.format_string(f"%.{k}f", a) for k in (2, 3)] + [F.regexp_replace(F.format_string("%.4f", a), "0+$", ""), F.coalesce(plain, a.cast("string"))]
    whole = F.when(a >= 1000, F.array(a.cast("long").cast("string"))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.array_distinct(F.array(*fixed)), lambda s: ~s.isin("0.00", "0.000", "0."))
    finite = a.isNotNull() & ~F.isnan(a) & (a != F.lit(float("inf")))
    return F.when(finite & (a == F.floor(a)), whole).when(finite, parts).otherwise(F.array().cast("array<string>"))


def holds_number(text: Column, forms: Column) -> Column:
    """One of the forms stands in the text, not as part of a longer number."""
    return F.exists(forms, lambda s: F.contains(text, s) & F.regexp_like(text, F.concat(F.lit("(?<![0-9.])"), F.regexp_replace(s, "\\.", "\\\\."), F.lit("(?![0-9])"))))


def numbers_of(text: Column) -> Column:
    """The distinct ways in which numbers of the text can be read: of each run of digits and points its first digits, with the point and the digits after it if there are some."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])([0-9]+(?:\.[0-9]*)?)"), F.lit(1))
    whole = F.transform(runs, lambda r: F.regexp_replace(r, r"\..*$", ""))
    return F.array_distinct(F.concat(runs, whole))


def leaked_numbers(documents: DataFrame, metrics: DataFrame, key: str, metric: str) -> DataFrame:
    """key, metric: which private numbers (metric, value) stand in which documents (key, text), each pair once.

    Numbers are pulled from the texts and joined with the forms that a private number may take, so the work grows with the texts and not with
    texts times numbers. A null text or number leaks nothing.
    """
    said = documents.select(key, F.explode(numbers_of(F.col("text"))).alias("form"))
    forms = metrics.select(metric, F.explode(F.array_distinct(number_forms(F.col("value")))).alias("form"))
    return said.join(forms, "form").select(key, metric).distinct()


def route_gate(verdict: Column, attempt: Column, most: Column) -> Column:
    spent = attempt >= most
    return F.when(verdict == "ACCEPTED", "codegen").when(verdict == "FAILED_GATE", "abandon").when(verdict.isin("INSUFFICIENT_SAMPLE", "COST_DOMINATED", "UNSTABLE_ACROSS_FOLDS"), F.when(spent, "abandon").otherwise("retry"))


def route_formula(verdict: Column, attempt: Column, most: Column) -> Column:
    return F.when(verdict.isin("INVALID_AST", "TOO_COMPLEX", "REDUNDANT"), F.when(attempt >= most, "abandon").otherwise("retry")).when(verdict.isNull(), "proof")


def route_proof(status: Column, attempt: Column, most: Column) -> Column:
    """Where a trial goes when its proof is done; NULL for a status that no proof ends with."""
    return F.when(status == "FAILED", F.when(attempt >= most, "abandon").otherwise("retry")).when(status.isin("PASSED", "SKIPPED"), "backtest")


def rejection(who: Column, observable: Column, computable: Column, instrumentable: Column, horizon: Column, lo: Column, hi: Column, seen: Column) -> Column:
    """The first of the five reasons against a hypothesis, or NULL."""
    return (
        F.when((F.trim(who) == "") | circular(who), "CIRCULAR_PAYER").when(~computable | (F.trim(observable) == ""), "NOT_COMPUTABLE").when(~instrumentable, "NOT_INSTRUMENTABLE")
        .when(~horizon.between(lo, hi), "HORIZON_OUT_OF_RANGE").when(seen, "DUPLICATE")
    )

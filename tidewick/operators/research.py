"""The family catalogue, hypotheses and pre-registration: settings read on the driver, and their rules."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewick.functions.scalar import BUCKETS
from tidewick.plans.formula import OPERATORS, SERIES, Constraints, Node, minutes

#: Name, mechanism, typical payer, data, horizon in minutes, allowed and forbidden operators, session, available.
CATALOGUE = (
    (
        "INTERMERCADO_SP500", "atraso na transmissão de choque do S&P futuro", "market maker que alarga spread na incerteza e não repassa",
        ("WIN", "ES"), 2, 10, ("zscore", "ret", "lag", "rolling_std", "sub", "mul", "in_window", "ref"), ("rank_ts",), ("10:30", "16:30"), True,
    ),
    (
        "ABERTURA_E_GAP", "informação do overnight ainda não precificada", "quem precisa executar na abertura, independente do preço",
        ("WIN",), 5, 30, ("zscore", "ret", "lag", "rolling_mean", "rolling_std", "sub", "gt", "in_window", "minutes_since_open"), ("rank_ts", "ref"), ("09:00", "11:00"), True,
    ),
    (
        "REGIME_DE_VOL", "mudança de regime altera o comportamento do preço", "quem opera com parâmetro fixo através da mudança",
        ("WIN",), 20, 60, ("zscore", "rolling_std", "ema", "ret", "div", "gt", "in_window", "clip"), ("rank_ts", "ref"), (), True,
    ),
    (
        "INTERMERCADO_DOLAR", "fluxo estrangeiro move o dólar antes do índice", "hedger local que precisa ajustar exposição",
        ("WIN", "WDO"), 5, 20, ("zscore", "ret", "lag", "rolling_std", "sub", "mul", "in_window", "ref"), ("rank_ts",), ("09:00", "17:00"), True,
    ),
    (
        "REVERSAO_HORARIA", "exagero em horários de baixa liquidez", "retail alavancado, liquidado em cascata",
        ("WIN",), 10, 40, ("zscore", "ret", "rolling_mean", "rolling_std", "sub", "lt", "gt", "in_window", "minutes_since_open"), ("rank_ts", "ref"), (), True,
    ),
    (
        "LIQUIDEZ_E_HORARIO", "spread e profundidade variam previsivelmente ao longo do dia", "quem executa no horário errado por conveniência",
        ("WIN",), 5, 20, ("zscore", "rolling_mean", "rolling_std", "div", "in_window", "minutes_since_open", "gt"), ("rank_ts", "ref"), (), True,
    ),
    (
        "ROLAGEM_DE_VENCIMENTO", "distorção de preço na virada do contrato", "quem rola tarde e paga o spread alargado",
        ("WIN",), 1440, 4320, ("zscore", "ret", "lag", "rolling_mean", "sub", "gt"), ("rank_ts", "ref", "in_window"), (), True,
    ),
    (
        "FLUXO_DE_AGRESSAO", "desequilíbrio entre agressores de compra e venda", "market maker que não reprecifica a tempo",
        ("WIN", "BOOK"), 1, 5, ("zscore", "div", "rolling_mean", "gt", "in_window"), ("rank_ts",), (), False,
    ),
)
STARTERS = ("INTERMERCADO_SP500", "ABERTURA_E_GAP", "REGIME_DE_VOL")
#: Kill metrics that can be measured.
INSTRUMENTABLE = ("lag_ms", "spread_ticks", "realized_vol", "gap_overnight", "minutes_to_open", "ref_corr", "fill_ratio")
SCHEMA = "name string, mechanism string, typical_payer string, data_needed array<string>, horizon_lo int, horizon_hi int, allowed_ops array<string>, forbidden_ops array<string>, session_hint array<string>, available boolean, place int"


class SettingError(Exception):
    """A setting that is missing, repeated or out of range."""


def families(spark: SparkSession, names: tuple[str, ...] | None = None) -> DataFrame:
    """The catalogue, or the named families in the order of names."""
    known = {r[0]: r for r in CATALOGUE}
    names = tuple(known) if names is None else names
    if len(set(names)) != len(names) or any(n not in known for n in names):
        raise SettingError("unknown or repeated family")
    rows = [(n, m, p, d, lo, hi, a, f, s or None, ok, i) for i, (n, m, p, d, lo, hi, a, f, s, ok) in enumerate(known[n] for n in names)]
    return spark.createDataFrame(rows, SCHEMA)


def catalogue_sha256(names: tuple[str, ...] | None = None) -> str:
    """The hash of the catalogue's canonical JSON."""
    body = []
    for n, m, p, d, lo, hi, a, f, s, ok in CATALOGUE:
        if names is None or n in names:
            upper = lambda words: sorted(x.upper() for x in words)
            body.append({"name": n, "mechanism": m, "typical_payer": p, "data_needed": sorted(d), "horizon_range": [lo, hi], "allowed_ops": upper(a), "forbidden_ops": upper(f), "session_hint": list(s) or None, "available": ok})
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def permitted(c: Constraints) -> list[str]:
    """The operators that a formula under c may use."""
    return [o for o in OPERATORS if o != "const" and o not in c.forbidden and (o in SERIES or o in c.allowed)]


def duration_minutes(text: str) -> float:
    """Of PT1H30M and the like; must be positive."""
    m = re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?", text)
    total = sum(int(x or 0) * k for x, k in zip(m.groups(), (3600, 60, 1), strict=True)) if m else 0
    if total <= 0:
        raise SettingError(f"not a duration: {text!r}")
    return total / 60


def duration_text(mins: float) -> str:
    seconds = round(mins * 60)
    parts = zip((seconds // 3600, seconds % 3600 // 60, seconds % 60), "HMS", strict=True)
    return "PT" + "".join(f"{v}{u}" for v, u in parts if v)


def load_hypothesis(path: str) -> dict:
    """A hypothesis of a YAML file: its fields, `constraints` and `horizon_min`."""
    import yaml

    with open(path, encoding="utf-8") as f:
        h = yaml.safe_load(f)
    need = ("id", "family", "claim", "who_pays", "observable", "direction", "horizon", "session_window", "kill_condition", "dsl_constraints")
    if not isinstance(h, dict) or (missing := [k for k in need if h.get(k) is None]):
        raise SettingError(f"missing: {missing if isinstance(h, dict) else need}")
    if h["direction"] not in ("LONG_ON_HIGH", "SHORT_ON_HIGH"):
        raise SettingError("direction")
    window = h["session_window"]
    lo, hi = (window["start"], window["end"]) if isinstance(window, dict) else window
    if minutes(str(lo)) >= minutes(str(hi)):
        raise SettingError("the session ends before it starts")
    c = h["dsl_constraints"]
    ops = lambda k: frozenset(o.lower() for o in c[k])
    if bad := (ops("allowed_ops") | ops("forbidden_ops")) - set(OPERATORS) | ({"const"} & (ops("allowed_ops") | ops("forbidden_ops"))):
        raise SettingError(f"operators: {sorted(bad)}")
    limits = Constraints(ops("allowed_ops"), ops("forbidden_ops"), c["max_window"], c["max_depth"], c["max_nodes"], c["max_free_params"], frozenset(c["required_refs"]))
    return {**h, "horizon_min": duration_minutes(h["horizon"]), "session_window": (str(lo), str(hi)), "constraints": limits}


def tightened(c: Constraints, verdict: str, horizon_min: int, horizon_hi: int) -> tuple[Constraints, int]:
    """Constraints and horizon for the next attempt after a verdict."""
    if verdict == "TOO_COMPLEX":
        return dataclasses.replace(c, max_depth=max(1, c.max_depth - 1)), horizon_min
    if verdict == "UNSTABLE_ACROSS_FOLDS":
        return dataclasses.replace(c, max_window=max(2, c.max_window // 2)), horizon_min
    if verdict == "COST_DOMINATED":
        return c, min(next((b for b in BUCKETS if b > horizon_min), horizon_min), horizon_hi)
    return c, horizon_min


def without_root(c: Constraints, n: Node) -> Constraints:
    """After a redundant formula its root operator is forbidden, unless it is a base series."""
    return c if n.op in SERIES else dataclasses.replace(c, forbidden=c.forbidden | {n.op})


@dataclasses.dataclass(frozen=True)
class Budget:
    max_attempts: int = 10
    max_formulas: int = 25
    max_trials: int = 3000
    max_proof_iterations: int = 15

    def spent(self, trials: int = 0, formulas: int = 0) -> bool:
        return trials >= self.max_trials or formulas >= self.max_formulas


PREREG = {
    "min_total_trades": int, "min_trades_per_path": int, "min_active_days": int, "max_trade_concentration": float, "max_sign_flip_frac": float, "max_pbo": float, "min_dsr": float,
    "MAX_TRIALS": int, "n_grupos": int, "k_teste": int, "embargo_mult": float, "caminhos": int,
}
RENAMED = {"MAX_TRIALS": "max_trials", "n_grupos": "n_groups", "k_teste": "k_test"}


def read_preregistration(text: str, sha256: str | None = None) -> dict:
    """The gate's limits from the fenced blocks of a document; refuses open decisions and another document than the registered one."""
    fields: dict[str, str] = {}
    inside = False
    for line in text.splitlines():
        if line.startswith("```"):
            inside = not inside
        elif inside and (m := re.fullmatch(r"\s*([A-Za-z_][\w-]*)\s*:\s*(.*?)\s*(?:#.*)?", line)):
            if m[1] in fields:
                raise SettingError(f"repeated: {m[1]}")
            fields[m[1]] = m[2]
    if still := [k for k, v in fields.items() if "<<< DECIDIR >>>" in v]:
        raise SettingError(f"undecided: {still}")
    if sha256 and hashlib.sha256(text.encode()).hexdigest() != sha256:
        raise SettingError("not the registered document")
    out = {}
    for k, kind in PREREG.items():
        try:
            out[RENAMED.get(k, k)] = kind(fields[k].replace(".", "").replace("_", "") if kind is int else fields[k].replace(",", "."))
        except (KeyError, ValueError):
            raise SettingError(f"missing or wrong: {k}") from None
    shares = [out[k] for k in ("max_trade_concentration", "max_sign_flip_frac", "max_pbo", "min_dsr")]
    counts = [out[k] for k in ("min_total_trades", "min_trades_per_path", "min_active_days", "max_trials")]
    if not all(0 <= x <= 1 for x in shares) or min(counts) < 1 or not 1 <= out["k_test"] < out["n_groups"] or not 0 <= out["embargo_mult"] < math.inf or out.pop("caminhos") != math.comb(out["n_groups"], out["k_test"]):
        raise SettingError("out of range")
    return out


def projected(rows: DataFrame, fields: list[str]) -> DataFrame:
    """payload: the whitelisted fields only, as JSON with sorted keys."""
    return rows.select(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("payload"))

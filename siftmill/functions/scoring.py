"""Score arithmetic as column expressions: softmax, rules, soft targets, intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WILSON_Z = 1.96
# Weights of the soft targets and of the prediction blend.
TARGET_W, CONTROVERSY_W, UNSURE_CAP, SMOOTHING = 0.5, 0.25, 0.9, 0.05


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def log_softmax(logits: list[Column], at: Column) -> Column:
    """Log-probability of class ``at`` (0-based)."""
    top = F.greatest(*logits)
    total = F.log(sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top)))
    chosen = F.element_at(F.array(*logits), (at + 1).cast("int"))
    return chosen - top - total


@dataclass(frozen=True)
class Rule:
    group: str  # offensive, defensive or target
    pattern: str
    weight: float


def load_rules(groups: dict[str, list[dict]]) -> list[Rule]:
    """Rules of a parsed rule file: group -> entries with pattern and weight."""
    unknown = set(groups) - {"offensive", "defensive", "target"}
    if unknown:
        raise ValueError(f"unknown rule groups {sorted(unknown)}")
    return [Rule(g, e["pattern"], float(e["weight"])) for g, entries in groups.items() for e in entries]


def matched_weight(text: Column, rules: list[Rule], group: str) -> Column:
    """Each rule counts once per text."""
    out = F.lit(0.0)
    for r in rules:
        if r.group == group:
            out = out + F.when(text.rlike("(?i)" + r.pattern), F.lit(r.weight)).otherwise(F.lit(0.0))
    return out


def keyword_logits(text: Column, rules: list[Rule]) -> list[Column]:
    return rule_logits(*(matched_weight(text, rules, g) for g in ("offensive", "target", "defensive")))


def rule_logits(off: Column, tgt: Column, dfn: Column) -> list[Column]:
    """Logits (safe, dangerous, unsure) of a text's weights in the three groups of rules."""
    s, m = off + tgt - dfn, off + tgt + dfn
    return [-s, s, F.lit(-1.5) + F.lit(0.6) * m - F.abs(s)]


def soft_target(p: Column, y: Column, disagreement: Column | None = None, controversial: Column | None = None) -> dict[str, Column]:
    """d, u and the normalised (t_safe, t_dangerous, t_unsure) of teacher probability p and label y (nullable)."""
    d = F.coalesce(F.abs(p - y), F.lit(0.0))
    u = F.lit(TARGET_W) * clip(F.lit(2.0) * (d - F.lit(0.25))) + F.lit(0.25) * (F.lit(1.0) - F.abs(F.lit(2.0) * p - F.lit(1.0)))
    if disagreement is not None:
        u = u + F.lit(0.25) * clip(F.lit(2.0) * disagreement)
    if controversial is not None:
        u = u + F.lit(CONTROVERSY_W) * F.coalesce(controversial, F.lit(0.0))
    u = F.least(u, F.lit(UNSURE_CAP))
    raw = [(F.lit(1.0) - p) * (F.lit(1.0) - u), p * (F.lit(1.0) - u), u]
    total = raw[0] + raw[1] + raw[2]
    return {"d": d, "u": u, "t_safe": raw[0] / total, "t_dangerous": raw[1] / total, "t_unsure": raw[2] / total}


def source_only_target(y: Column, smoothing: float = SMOOTHING) -> dict[str, Column]:
    p = F.when(y.isNull(), F.lit(0.5)).otherwise(y * F.lit(1 - 2 * smoothing) + F.lit(smoothing))
    u = F.when(y.isNull(), F.lit(0.5)).otherwise(F.lit(0.0))
    raw = [(F.lit(1.0) - p) * (F.lit(1.0) - u), p * (F.lit(1.0) - u), u]
    total = raw[0] + raw[1] + raw[2]
    return {"p": p, "u": u, "t_safe": raw[0] / total, "t_dangerous": raw[1] / total, "t_unsure": raw[2] / total}


def nan_mean(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / F.lit(2.0), a, b)


def teacher_blend(p1: Column, p2: Column | None, c: Column | None, w_c: float = 0.5, w_d: float = 0.5) -> list[Column]:
    """(p_safe, p_dangerous, p_unsure) of one teacher, or of two: unsure grows with
    controversy and disagreement, and the three are scaled to sum to one."""
    c = F.coalesce(c, F.lit(0.0)) if c is not None else F.lit(0.0)
    if p2 is None:
        return [F.lit(1.0) - p1 - c, p1, c]
    p = (p1 + p2) / F.lit(2.0)
    u = F.lit(w_c) * c + F.lit(w_d) * F.abs(p1 - p2)
    raw = [F.greatest(F.lit(1.0) - p - u, F.lit(0.0)), p, u]
    total = raw[0] + raw[1] + raw[2]
    return [x / total for x in raw]


def binary_verdict(unsafe: Column, safe: Column) -> Column:
    return softmax([unsafe, safe])[0]


def three_way_verdict(unsafe: Column, safe: Column, controversial: Column) -> tuple[Column, Column]:
    """(p_unsafe, p_controversial)."""
    p = softmax([unsafe, safe, controversial])
    return p[0], p[2]


def llama_category(said: Column) -> Column:
    return F.regexp_extract(said, r"S(\d+)", 0)


def listed_category(said: Column) -> Column:
    got = F.trim(F.regexp_extract(said, r"Categories:\s*([^\n]*)", 1))
    return F.when(F.lower(got) == "none", F.lit("")).otherwise(got)


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """95% interval of a rate k/n, NULL when n is 0."""
    k, n = k.cast("double"), F.nullif(n, F.lit(0)).cast("double")
    p, z2 = k / n, F.lit(z * z)
    d = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / d
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / d
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def rate(k: Column, n: Column) -> Column:
    low, high = wilson(k, n)
    return F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), (k / F.nullif(n, F.lit(0))).alias("value"), low.alias("ci_lo"), high.alias("ci_hi"))

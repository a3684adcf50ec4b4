"""Strategy configuration, the block pipeline that compiles to it, and the preset strategies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import count

from ..operators.indicators import REGISTRY

CONDITIONS = ("crosses_above", "crosses_below", "is_above", "is_below", "between")
DIRECTIONS = ("long", "short", "both")
REBALANCE = ("daily", "weekly", "biweekly", "monthly")

#: Types whose trigger without a reference compares the close with the indicator.
TREND_TYPES = ("sma", "ema", "dema", "tema", "wma", "hull_ma", "vwma", "linear_regression", "parabolic_sar")


@dataclass(frozen=True)
class IndicatorConfig:
    type: str
    params: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    indicator: int
    condition: str
    direction: str = "both"
    threshold: float | None = None
    reference: int | None = None

    def __post_init__(self):
        if self.condition not in CONDITIONS or self.direction not in DIRECTIONS:
            raise ValueError(f"unknown condition or direction: {self.condition}, {self.direction}")

    @property
    def is_level(self) -> bool:
        return self.condition in ("is_above", "is_below")


@dataclass(frozen=True)
class Sizing:
    risk_budget: float = 500_000
    vol_window: int = 20
    z_multiplier: float = 1.65


@dataclass(frozen=True)
class Strategy:
    indicators: tuple[IndicatorConfig, ...]
    rules: tuple[Rule, ...]
    logic: str = "or"
    sizing: Sizing = Sizing()
    rebalance: str = "daily"

    def __post_init__(self):
        if self.rebalance not in REBALANCE or self.logic not in ("or", "and"):
            raise ValueError(f"unknown rebalance or logic: {self.rebalance}, {self.logic}")


def _strategy(indicators: Sequence[tuple[str, dict]], rules: Sequence[Rule], rebalance: str, logic: str = "or") -> Strategy:
    return Strategy(tuple(IndicatorConfig(t, p) for t, p in indicators), tuple(rules), logic, Sizing(), rebalance)


#: The preset strategies.
PRESETS: dict[str, Strategy] = {
    "golden_cross": _strategy([("sma", {"period": 50}), ("sma", {"period": 200})], [Rule(0, "is_above", reference=1)], "weekly"),
    "rsi_mean_reversion": _strategy([("rsi", {"period": 14})], [Rule(0, "crosses_above", "long", 30), Rule(0, "crosses_below", "short", 70)], "daily"),
    "bollinger_bounce": _strategy([("bb_pct_b", {"period": 20, "std_dev": 2})], [Rule(0, "crosses_above", "long", 0), Rule(0, "crosses_below", "short", 1)], "daily"),
    "macd_crossover": _strategy([("macd", {"fast": 12, "slow": 26, "signal": 9})], [Rule(0, "is_above", threshold=0)], "weekly"),
    "supertrend": _strategy([("supertrend", {"period": 10, "multiplier": 3})], [Rule(0, "is_above", threshold=0)], "daily"),
    "triple_ma": _strategy([("ema", {"period": n}) for n in (9, 21, 55)], [Rule(0, "is_above", reference=1), Rule(1, "is_above", reference=2)], "weekly", "and"),
    "momentum_6m": _strategy([("ts_momentum", {"period": 126})], [Rule(0, "is_above", threshold=0)], "monthly"),
}


@dataclass(frozen=True)
class Block:
    """kind "indicator" (type, params), "trigger" (source, condition, threshold, reference) or "action" (trigger, direction)."""

    id: str
    kind: str
    type: str = ""
    params: dict[str, float] = field(default_factory=dict)
    source: str = ""
    condition: str = "is_above"
    threshold: float | None = None
    reference: str | None = None
    trigger: str = ""
    direction: str = "both"


_ids = count(1)


def new_id() -> str:
    return f"block-{next(_ids)}"


def blocks_to_strategy(blocks: Sequence[Block], sizing: Sizing = Sizing(), rebalance: str = "daily", logic: str = "or") -> Strategy | None:
    """A trend trigger without a reference becomes a rule of the close against the trend; dangling references are skipped; no indicator gives None."""
    sources = {b.id: b for b in blocks if b.kind == "indicator"}
    if not sources:
        return None
    triggers = [b for b in blocks if b.kind == "trigger"]
    direction = {}
    for b in blocks:
        if b.kind == "action":
            direction.setdefault(b.trigger, b.direction)
    against_close = {t.id for t in triggers if not t.reference and t.source in sources and sources[t.source].type in TREND_TYPES}
    indicators = [IndicatorConfig("close_price")] * bool(against_close)
    position = {}
    for key, b in sources.items():
        position[key] = len(indicators)
        indicators.append(IndicatorConfig(b.type, dict(b.params)))
    rules = []
    for t in triggers:
        way = direction.get(t.id, "both")
        if t.source not in position or (t.reference and t.reference not in position):
            continue
        if t.reference:
            rules.append(Rule(position[t.source], t.condition, way, reference=position[t.reference]))
        elif t.id in against_close:
            rules.append(Rule(0, t.condition, way, reference=position[t.source]))
        else:
            rules.append(Rule(position[t.source], t.condition, way, threshold=t.threshold or 0))
    return Strategy(tuple(indicators), tuple(rules), logic, sizing, rebalance)


def strategy_to_blocks(strategy: Strategy) -> list[Block]:
    """The inverse, but for rules on the close, which are lost."""
    own = {k: Block(new_id(), "indicator", i.type, dict(i.params)) for k, i in enumerate(strategy.indicators) if i.type != "close_price"}
    rest = []
    for r in strategy.rules:
        if r.indicator in own:
            ref = own[r.reference].id if r.reference in own else None
            t = Block(new_id(), "trigger", source=own[r.indicator].id, condition=r.condition, threshold=r.threshold, reference=ref)
            rest += [t, Block(new_id(), "action", trigger=t.id, direction=r.direction)]
    return [*own.values(), *rest]


#: Thresholds of the trigger that a new indicator starts with; trend types have none, others 0.
FIRST_THRESHOLD = {"rsi": 50, "stoch_rsi": 50, "mfi": 50, "cci": 0, "williams_r": -50, "bb_pct_b": 0.5}


def default_blocks(type_: str) -> list[Block]:
    own = Block(new_id(), "indicator", type_, dict(REGISTRY[type_].defaults))
    threshold = FIRST_THRESHOLD.get(type_, None if type_ in TREND_TYPES else 0)
    trigger = Block(new_id(), "trigger", source=own.id, threshold=threshold)
    return [own, trigger, Block(new_id(), "action", trigger=trigger.id)]


def _needs(b: Block) -> set[str]:
    return {x for x in ((b.source, b.reference) if b.kind == "trigger" else (b.trigger,) if b.kind == "action" else ()) if x}


def valid_order(blocks: Sequence[Block]) -> bool:
    seen: set[str] = set()
    for b in blocks:
        if not _needs(b) <= seen:
            return False
        seen.add(b.id)
    return True


def remove_cascade(blocks: Sequence[Block], block_id: str) -> list[Block]:
    """Without the block and all that depends on it."""
    gone = {block_id}
    for kind in ("trigger", "action"):
        gone |= {b.id for b in blocks if b.kind == kind and _needs(b) & gone}
    return [b for b in blocks if b.id not in gone]


def duplicate(blocks: Sequence[Block], block_id: str) -> list[Block]:
    """With a copy of an indicator after it."""
    return [x for b in blocks for x in ([b, replace(b, id=new_id(), params=dict(b.params))] if b.id == block_id and b.kind == "indicator" else [b])]


def warnings(blocks: Sequence[Block]) -> list[str]:
    used = set().union(*map(_needs, blocks)) if blocks else set()
    found = []
    for b in blocks:
        if b.kind == "indicator" and b.id not in used:
            found.append(f"{label(b.type, b.params)} is not used by a trigger")
        elif b.kind == "trigger" and b.id not in used:
            found.append("a trigger has no action")
        elif b.kind == "action" and b.trigger not in {x.id for x in blocks}:
            found.append("an action has no trigger")
    return found


def label(type_: str, params: dict[str, float]) -> str:
    """Name with parameters in their order, defaults where not given; a type without parameters, or not known, is its name alone."""
    if type_ not in REGISTRY:
        return type_
    values = REGISTRY[type_].defaults | {k: v for k, v in params.items() if k in REGISTRY[type_].defaults}
    return REGISTRY[type_].label + (f"({','.join(f'{v:g}' for v in values.values())})" if values else "")

"""Dictionaries and numbers that the operators work with: plain data, given by the user.

Keyword lists, rules, priors and role patterns belong to a study, not to the engine, so they are
read from JSON. Only small tables that fix an operator's result stand here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

# Weights of the five dimensions, of observed evidence, tiers and calibration range.
DIMENSIONS = ("R", "S", "D", "A", "H")
WEIGHTS = {"R": 0.25, "S": 0.20, "D": 0.20, "A": 0.20, "H": 0.15}
EVIDENCE_WEIGHTS = {"R": 0.40, "S": 0.40, "D": 0.60, "A": 0.60, "H": 0.60}
TIERS = ((70.0, "高替代风险"), (40.0, "中等替代风险"), (0.0, "低替代风险"))
CALIBRATION = (10.0, 90.0)

# Ordinal levels of degree and experience texts, and the level of any other text.
DEGREE_LEVELS = {"学历不限": 1, "中专/中技": 1, "高中": 1, "大专": 2, "本科": 3, "硕士": 4, "博士": 5}
EXPERIENCE_LEVELS = {"经验不限": 1, "在校/应届": 1, "1年以内": 1, "1-3年": 2, "3-5年": 3, "5-10年": 4, "10年以上": 5}
DEGREE_DEFAULT, EXPERIENCE_DEFAULT = 3, 2

# Words that stand for no value, and the starts of sentences that say so.
NULL_TOKENS = ("", "无", "未提及", "未提供", "未说明", "未明确", "未明确说明", "未明确提及", "招聘信息中未提及", "招聘信息中未提供", "招聘信息未提及", "n/a", "na", "none", "null", "-", "—", "不详", "未知", "无明确要求", "未提及（一般要求本科及以上）")
NULL_STARTS = ("未提及", "未提供", "未说明", "无")

# The fields of an extracted record.
SCALAR_FIELDS = ("职位名称", "最低薪资", "最高薪资", "薪资周期", "工作地点", "学历要求", "经验要求")
LIST_FIELDS = ("硬技能", "软技能", "AI相关技术栈要求")
REQUIRED_KEYS = ("职位名称", "薪资范围", "工作地点", "技能要求", "学历要求", "经验要求", "AI相关技术栈要求")
PAY_KEYS, SKILL_KEYS = ("最低薪资", "最高薪资", "薪资周期"), ("硬技能", "软技能")

# Share of working time that is left by who does the task (A machine, C both, H human).
TIME_FACTORS = {"A": 0.15, "C": 0.55, "H": 1.0}


@dataclass(frozen=True)
class Rule:
    """One class of an ordered classification: any keyword and none of the excluded words."""

    name: str
    keywords: tuple[str, ...]
    excludes: tuple[str, ...] = ()
    strict: tuple[str, ...] = ()


@dataclass(frozen=True)
class Role:
    """One role of an ordered claim: pattern, excluded pattern, and the class that gives its baseline."""

    name: str
    pattern: str
    exclude: str = ""
    anchor: str = ""


@dataclass(frozen=True)
class TitleSpec:
    """What title normalisation cuts from the start and the end, and synonyms of the result."""

    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    synonyms: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Study:
    """All dictionaries of one study."""

    rules: tuple[Rule, ...] = ()
    fallback: str = "other"
    roles: tuple[Role, ...] = ()
    titles: TitleSpec = TitleSpec()
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    priors: dict[str, dict[str, float]] = field(default_factory=dict)
    rationales: dict[str, str] = field(default_factory=dict)
    core: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def order(self) -> tuple[str, ...]:
        """Class names in their fixed order, the fallback last."""
        return (*(r.name for r in self.rules), self.fallback)


def load_study(path: str | Path) -> Study:
    """A study from a JSON file with the fields of Study."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    t = raw.get("titles", {})
    return Study(
        rules=tuple(Rule(r["name"], tuple(r["keywords"]), tuple(r.get("excludes", ())), tuple(r.get("strict", ()))) for r in raw.get("rules", ())),
        fallback=raw.get("fallback", "other"),
        roles=tuple(Role(r["name"], r["pattern"], r.get("exclude", ""), r.get("anchor", "")) for r in raw.get("roles", ())),
        titles=TitleSpec(tuple(t.get("prefixes", ())), tuple(t.get("suffixes", ())), dict(t.get("synonyms", {}))),
        keywords={k: tuple(v) for k, v in raw.get("keywords", {}).items()},
        priors=raw.get("priors", {}),
        rationales=raw.get("rationales", {}),
        core=tuple(raw.get("core", ())),
        aliases=raw.get("aliases", {}),
    )

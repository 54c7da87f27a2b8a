"""Qualify data with Spark: features, named rules, verdicts, audits and models as DataFrame plans."""

from gatehouse.operators.repair import repair
from gatehouse.operators.rules import Rule, RuleSet
from gatehouse.plans.registry import GATES, QualifyError, QualifyResult, modalities, qualify

__all__ = ["GATES", "QualifyError", "QualifyResult", "Rule", "RuleSet", "modalities", "qualify", "repair"]

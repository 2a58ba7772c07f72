"""Prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.fixed_values import CRITERIA_TEMPLATE, PROMPT_TEMPLATE
from siftwell.spec import Criteria


def criteria_block(criteria: Criteria) -> str:
    return CRITERIA_TEMPLATE.format(
        forbidden_words=", ".join(criteria.forbidden_words),
        topics_to_exclude=", ".join(criteria.topics_to_exclude),
        tone_requirements=", ".join(criteria.tone_requirements),
        additional_instructions=criteria.additional_instructions,
    )


def prompt(text: Column, criteria: Criteria) -> Column:
    """Constant text around the post's own text, which goes in unescaped."""
    head, tail = PROMPT_TEMPLATE.split("{tweet_text}")
    tail = tail.replace("{criteria}", criteria_block(criteria))
    return F.concat(F.lit(head), F.coalesce(text, F.lit("")), F.lit(tail))

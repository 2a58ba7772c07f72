"""Reading the model's answers: strict JSON with built-in expressions only.

from_json alone is too lenient: it ignores whatever follows the first complete
value. So a text is put into an array together with a closing object that holds a
random mark, and only counts when exactly these two elements come back. A text that
closes the array itself can't know the mark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.fixed_values import ANSWER_OBJECT_PATTERN, CODE_FENCES, REQUIRED_KEYS

#: Drawn anew by every process that plans a parse; texts can't contain it but by chance.
MARK = uuid.uuid4().hex
ENVELOPE = (
    "struct<key: string, tweet_url: string, response: struct<candidates: "
    "array<struct<content: struct<parts: array<struct<text: string>>>>>>>"
)
OBJECT = "map<string, string>"
_OPTIONS = {"allowSingleQuotes": "false"}
_TEXT_PATH = "$.response.candidates[0].content.parts[0].text"


def elements(text: Column, schema: str) -> Column:
    """The text and an object with the mark as the elements of one array."""
    return F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"key":"{MARK}"}}]')), f"array<{schema}>", _OPTIONS)


def sole(found: Column) -> Column:
    """The text's own value if nothing else came back with it, else null.

    Refers to its argument several times: pass a column, not the parse itself, or it is
    parsed as often.
    """
    ends = (F.size(found) == 2) & (F.get(found, F.lit(1))["key"] == MARK)
    return F.when(ends, F.get(found, F.lit(0)))


def _only_part(parsed: Column) -> Column:
    """Text of an answer with one candidate of one part; null for other shapes."""
    candidates = parsed["response"]["candidates"]
    parts = F.get(candidates, F.lit(0))["content"]["parts"]
    single = (F.size(candidates) == 1) & (F.size(parts) == 1)
    return F.when(single, F.get(parts, F.lit(0))["text"])


def has_key(parsed: Column, line: Column) -> Column:
    """Whether the line is a JSON object with a key; a null key counts as one.

    A damaged field can come back as null without spoiling its line. So a line
    is only taken as sound at once when nothing that is read from it is null;
    the others are parsed again into a map, which takes all or nothing.
    """
    sound = parsed["key"].isNotNull() & parsed["tweet_url"].isNotNull() & _only_part(parsed).isNotNull()
    checked = F.map_contains_key(sole(elements(line, OBJECT)), "key")
    return F.when(parsed.isNull(), F.lit(False)).otherwise(
        F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(F.coalesce(checked, F.lit(False)))
    )


def answer_text(parsed: Column, line: Column) -> Column:
    """Text of the first part of the first candidate.

    With more than one candidate or part, or an odd one, the path is looked up
    in the line itself.
    """
    looked_up = F.when(parsed["response"].isNotNull(), F.get_json_object(line, _TEXT_PATH))
    return F.coalesce(_only_part(parsed), looked_up)


def without_fences(text: Column) -> Column:
    """Every fence removed, also inside values; most answers have none to remove."""
    stripped = text
    for fence in CODE_FENCES:
        stripped = F.replace(stripped, F.lit(fence), F.lit(""))
    shortest = min(CODE_FENCES, key=len)
    return F.when(F.contains(text, F.lit(shortest)), stripped).otherwise(text)


def object_text(bare: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none.

    A text that starts and ends with its braces is taken as it stands, without
    running the pattern over it.
    """
    whole = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
    return F.when(whole, bare).otherwise(F.regexp_extract(bare, ANSWER_OBJECT_PATTERN, 0))


def last_value(values: Column, key: str | Column) -> Column:
    """Value of the last entry with this key, since the parsed map keeps repeats."""
    key = F.lit(key) if isinstance(key, str) else key
    back = F.array_position(F.reverse(F.map_keys(values)), key)
    return F.when(
        back > 0, F.get(F.map_values(values), (F.size(values) - back).cast("int"))
    )


def has_required_keys(values: Column) -> Column:
    wanted = F.array(*[F.lit(k) for k in REQUIRED_KEYS])
    present = F.array_intersect(F.map_keys(values), wanted)
    return F.coalesce(F.size(present) == len(REQUIRED_KEYS), F.lit(False))


def other_keys(values: Column) -> Column:
    """Map of the keys beyond the required ones."""
    wanted = F.array(*[F.lit(k) for k in REQUIRED_KEYS])
    keys = F.array_except(F.map_keys(values), wanted)
    found = F.map_from_arrays(keys, F.transform(keys, lambda k: last_value(values, k)))
    return F.when(F.size(keys) > 0, found).otherwise(F.create_map().cast("map<string, string>"))


def string_list(text: Column) -> Column:
    """Array of strings, null when the value is of another type."""
    return F.from_json(text, "array<string>", _OPTIONS)

"""Reading model replies: code fences, answers, id lists, generated questions."""

from pyspark.sql import Column, functions as F


def content_of(response: Column) -> Column:
    """Text of the first choice; null for a failed response."""
    return F.get(response["choices"], F.lit(0))["message"]["content"]


def unfence(content: Column) -> Column:
    """Drop a leading ```json and a trailing ``` mark, then blanks and line breaks at both ends."""
    opened = F.regexp_replace(content, r"^```json", "")
    closed = F.regexp_replace(opened, r"```\z", "")
    return F.regexp_replace(F.regexp_replace(closed, r"^\s+", ""), r"\s+\z", "")


def answer(content: Column) -> Column:
    """The ``answer`` field as text; '' if the reply failed or cannot be read."""
    parsed = F.from_json(unfence(content), "answer string")["answer"]
    return F.coalesce(parsed, F.lit(""))


def selected_ids(content: Column) -> Column:
    """A JSON list of ids; null if the reply is no such list."""
    text = unfence(content)
    return F.when(text.startswith("["), F.from_json(text, "array<string>"))


def first_key(content: Column) -> Column:
    return F.get(F.json_object_keys(unfence(content)), F.lit(0))


def generated_questions(content: Column) -> Column:
    """The question list under the first key of a JSON object; null if there is none."""
    text = unfence(content)
    lists = F.from_json(text, "map<string,array<string>>")
    return F.try_element_at(lists, F.get(F.json_object_keys(text), F.lit(0)))

"""Sub-ratings held as loose JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_SUBRATING = 5


def normalise_questions(questions: Column) -> Column:
    return F.when(questions.isNull() | questions.isin("", "None"), F.lit("{}")).otherwise(questions)


def question_map(questions: Column) -> Column:
    """Single quotes and ``null`` are repaired in the text, as the stored values need;
    text that is still no JSON object gives null."""
    repaired = F.replace(F.replace(questions, F.lit("null"), F.lit("0")), F.lit("'"), F.lit('"'))
    return F.from_json(repaired, "map<string,string>")


def sub_rating(parsed: Column, name: str) -> Column:
    """Key missing: 5. Stored null: 0 (by the repair). Not a number: null."""
    value = F.try_element_at(parsed, F.lit(name)).try_cast("double")
    return (F.when(parsed.isNull(), F.lit(None).cast("double"))
            .when(~F.map_contains_key(parsed, name), F.lit(float(MISSING_SUBRATING)))
            .otherwise(value))

"""Requests for an external classifier, written out for offline batch inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A default for callers without a prompt of their own; it asks for the reply's seven fields.
SYSTEM_PROMPT = (
    "Read the article and decide whether it concerns environmental, social or governance (ESG) "
    'matters. If it does not, answer {"esg_check":"No"}. Otherwise answer with one JSON object '
    "with these keys. categories: Environmental, Social or Governance, or blank. "
    "sentiment: Positive, Negative or Neutral. incidents: the incidents told, or "
    '"No incidents found". themes: a list of themes. summary: a short summary. '
    "country: the country of publication. date: the date in the article, as yyyy-MM-dd."
)

# The parameters of each classifier call.
PARAMETERS = {
    "model": "gpt-4o-mini",
    "temperature": 0.01,
    "presence_penalty": 0.5,
    "seed": 123,
    "response_format": "json_object",
}


def classifier_messages(text: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """``array<struct<role,content>>``: the instructions, then the article."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system_prompt)), message("user", text))


def classifier_request(
    text: Column, system_prompt: str = SYSTEM_PROMPT, parameters: dict | None = None
) -> Column:
    """One call as JSON text."""
    chosen = PARAMETERS if parameters is None else parameters
    fields = [
        F.struct(F.lit(v).alias("type")).alias(k) if k == "response_format" else F.lit(v).alias(k)
        for k, v in chosen.items()
    ]
    return F.to_json(F.struct(*fields, classifier_messages(text, system_prompt).alias("messages")))

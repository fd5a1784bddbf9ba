"""Responses of classifiers: lenient JSON, strict verdicts, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("label", "confidence", "reasons", "is_underage_or_ambiguous")


def extract_json(text: Column) -> Column:
    """The text as a variant if it is JSON, else what lies from its first { to its last }, else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def response_text(body: Column) -> Column:
    """The message of a chat completion; a list of parts is concatenated."""
    parsed = F.try_parse_json(body)
    whole = F.try_variant_get(parsed, "$.choices[0].message.content", "string")
    parts = F.try_variant_get(parsed, "$.choices[0].message.content", "array<struct<text:string>>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(whole)


def candidate_text(body: Column) -> Column:
    """All parts of the first candidate, concatenated."""
    parts = F.try_variant_get(F.try_parse_json(body), "$.candidates[0].content.parts", "array<struct<text:string>>")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def validate_verdict(parsed: Column, labels: tuple[str, ...]) -> Column:
    """The typed verdict of a variant, or null if it breaks a rule.

    label is one of labels, confidence a number from 0 to 1 (text is read),
    reasons a list of strings (missing: empty), the flag a boolean; no other key.
    """
    as_text = F.to_json(parsed)
    keys = F.json_object_keys(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), as_text))
    label = F.try_variant_get(parsed, "$.label", "string")
    confidence = F.try_variant_get(parsed, "$.confidence", "double")
    reasons = F.try_variant_get(parsed, "$.reasons", "array<string>")
    # a reason that is no string would be cast: its JSON then has no quotes
    listed = F.schema_of_variant(F.try_variant_get(parsed, "$.reasons", "variant"))
    reasons_ok = (~F.array_contains(keys, "reasons")) | listed.isin("ARRAY<STRING>", "ARRAY<VOID>")
    flag = F.try_variant_get(parsed, "$.is_underage_or_ambiguous", "boolean")
    valid = (
        keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) == 0) & label.isin(*labels)
        & confidence.between(0.0, 1.0) & ~F.isnan(confidence) & reasons_ok & flag.isNotNull()
    )
    return F.when(valid, F.struct(label.alias("label"), confidence.alias("confidence"), F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"), flag.alias("is_underage_or_ambiguous")))


def error_message(body: Column) -> Column:
    """error.message of a JSON body, else the body without white space at its ends."""
    return F.coalesce(F.nullif(F.try_variant_get(F.try_parse_json(body), "$.error.message", "string"), F.lit("")), F.regexp_replace(body, r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$", ""))


def error_class(message: Column) -> Column:
    """decode, no_vision, schema_unsupported or other, tested in this order."""
    m = F.lower(message)
    has = lambda *words: [F.contains(m, F.lit(w)) for w in words]
    image, vision, not_support, unsupported, decode, buffer, response_format, json_schema, schema = has("image", "vision", "not support", "unsupported", "decode", "buffer", "response_format", "json_schema", "schema")
    return (
        F.when(decode & (image | buffer), "decode")
        .when((image | vision) & (not_support | unsupported), "no_vision")
        .when(response_format | json_schema | (schema & unsupported), "schema_unsupported")
        .otherwise("other")
    )


def request_payload(model: Column, system: str, user: str, uri: Column, schema: str | None = None) -> Column:
    """The JSON body of a request: prompts, the data URI, temperature 0, and a response schema if given."""
    content = F.array(
        F.struct(F.lit("text").alias("type"), F.lit(user).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(uri.alias("url")).alias("image_url")),
    )
    messages = F.struct(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")).alias("system"),
        F.struct(F.lit("user").alias("role"), content.alias("content")).alias("user"),
    )
    fields = [model.alias("model"), F.lit(0).alias("temperature"), messages.alias("messages")]
    if schema is not None:
        fields.append(F.lit(schema).alias("response_format"))
    return F.to_json(F.struct(*fields))

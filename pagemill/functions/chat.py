"""Chat requests and responses as nested columns.

A message is ``struct(role, content)``, its content an array of ``struct(type, text,
url, data)``; plain text content is an array with one text part and no other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions.boxes import lookup
from pagemill.functions.strings import strip

PART_TYPE = "struct<type:string,text:string,url:string,data:string>"
MESSAGE_TYPE = f"struct<role:string,content:array<{PART_TYPE}>>"
REQUEST_TYPE = (
    f"struct<messages:array<{MESSAGE_TYPE}>,max_tokens:int,temperature:double,top_p:double,top_k:int,"
    "repetition_penalty:double>"
)
_RESPONSE = "struct<choices:array<struct<message:struct<content:string>>>,response:string,error:string>"

# --- fixed values: roles and the names of generation options ----------------
PASSED_ROLES = ("system", "assistant", "tool")
PROCESSED_ROLES = ("user", "observation")
OPTION_NAMES = {
    "max_tokens": "num_predict",
    "temperature": "temperature",
    "top_p": "top_p",
    "top_k": "top_k",
    "repetition_penalty": "repeat_penalty",
}
DEFAULT_PROMPT = "Text Recognition:"


def extract_image_sources(messages: Column) -> Column:
    """Image URLs and payloads of the user messages, in order."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    parts = F.flatten(F.transform(users, lambda m: F.coalesce(m["content"], F.array().cast(f"array<{PART_TYPE}>"))))
    images = F.filter(parts, lambda p: p["type"].isin("image_url", "image_bytes"))
    return F.transform(images, lambda p: F.when(p["type"] == "image_url", p["url"]).otherwise(p["data"]))


def extract_recognised_text(body: Column, generate_mode: bool = False) -> Column:
    """``struct(content, status, error)`` of a recognition response."""
    parsed = F.from_json(body, _RESPONSE)
    if generate_mode:
        has_error = F.get_json_object(body, "$.error").isNotNull()
        text = parsed["response"]
        error = F.when(has_error, F.concat(F.lit("API error: "), parsed["error"])).when(
            text.isNull(), "Invalid API response format: missing 'response' field"
        )
    else:
        choice = F.get(parsed["choices"], F.lit(0))
        text = F.coalesce(choice["message"]["content"], F.lit(""))
        error = F.when(choice["message"].isNull(), "Invalid API response format")
    ok = error.isNull()
    return F.struct(
        F.when(ok, strip(text)).alias("content"),
        F.when(ok, 200).otherwise(500).alias("status"),
        error.alias("error"),
    )


def build_request(
    image_uri: Column,
    task: Column,
    prompts: Mapping[str, str] = config.TASK_PROMPTS,
    defaults: Mapping[str, float] = config.GENERATION_DEFAULTS,
) -> Column:
    """JSON request for one region: its image, the prompt of its task, the parameters."""
    image = F.struct(
        F.lit("image_url").alias("type"),
        F.lit(None).cast("string").alias("text"),
        F.struct(image_uri.alias("url")).alias("image_url"),
    )
    prompt = F.coalesce(lookup(prompts, task), F.lit(""))
    text = F.struct(
        F.lit("text").alias("type"),
        prompt.alias("text"),
        F.lit(None).cast("struct<url:string>").alias("image_url"),
    )
    content = F.when(prompt != "", F.array(image, text)).otherwise(F.array(image))
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    parameters = [F.lit(value).alias(name) for name, value in defaults.items()]
    return F.to_json(F.struct(F.array(message).alias("messages"), *parameters))


def apply_request_defaults(request: Column, defaults: Mapping[str, float] = config.GENERATION_DEFAULTS) -> Column:
    """Request with absent parameters filled in, and an ``error`` for what is not accepted."""
    messages = request["messages"]
    bad_role = F.get(
        F.filter(messages, lambda m: ~m["role"].isin(*PASSED_ROLES, *PROCESSED_ROLES)), F.lit(0)
    )["role"]
    processed = F.filter(messages, lambda m: m["role"].isin(*PROCESSED_ROLES))
    parts = F.flatten(F.transform(processed, lambda m: m["content"]))
    bad_part = F.get(F.filter(parts, lambda p: ~p["type"].isin("text", "image_url")), F.lit(0))["type"]
    error = F.when(
        bad_role.isNotNull(), F.concat(bad_role, F.lit(" is not a valid role for a message."))
    ).when(bad_part.isNotNull(), F.concat(bad_part, F.lit(" is not a valid type.")))
    filled = [F.coalesce(request[name], F.lit(value)).alias(name) for name, value in defaults.items()]
    return F.struct(messages.alias("messages"), *filled, error.alias("error"))


def chat_to_generate(request: Column, model: str = "default") -> Column:
    """Single-prompt form of a chat request: the last user message and its images."""
    last = F.element_at(F.filter(request["messages"], lambda m: m["role"] == "user"), -1)
    last = F.when(F.exists(request["messages"], lambda m: m["role"] == "user"), last)
    texts = F.filter(last["content"], lambda p: p["type"] == "text")
    prompt = F.when(F.size(texts) > 0, F.element_at(texts, -1)["text"])
    urls = F.transform(F.filter(last["content"], lambda p: p["type"] == "image_url"), lambda p: F.coalesce(p["url"], F.lit("")))
    payloads = F.transform(
        urls, lambda u: F.when(u.startswith("data:"), F.get(F.split(u, ",", 2), F.lit(1))).otherwise(u)
    )
    payloads = F.filter(payloads, lambda p: p.isNotNull())
    given = [request[name].isNotNull() for name in OPTION_NAMES]
    any_given = given[0]
    for test in given[1:]:
        any_given = any_given | test
    options = F.struct(*[request[old].alias(new) for old, new in OPTION_NAMES.items()])
    return F.struct(
        F.lit(model).alias("model"),
        F.when(F.coalesce(prompt, F.lit("")) == "", DEFAULT_PROMPT).otherwise(prompt).alias("prompt"),
        F.lit(False).alias("stream"),
        F.when(F.size(payloads) > 0, payloads).alias("images"),
        F.when(any_given, options).alias("options"),
    )

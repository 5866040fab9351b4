"""Samples for supervised fine-tuning: conversations with images."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import config

# fixed values of the sample format
ROLES = ("user", "assistant")
IMAGE_TAG = "<image>"
MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def sample_problem(messages: Column, images: Column) -> Column:
    """What is wrong with a sample, null when nothing is.

    Roles are user or assistant; each image tag of the texts has one entry in ``images``; image paths are
    relative. Missing lists count as empty, a missing text as one without tags.
    """
    messages = F.coalesce(messages, F.array().cast(MESSAGES_TYPE))
    images = F.coalesce(images, F.array().cast("array<string>"))
    count_tags = lambda n, m: n + F.regexp_count(F.coalesce(m["content"], F.lit("")), F.lit(IMAGE_TAG))
    tags = F.aggregate(messages, F.lit(0), count_tags)
    absolute = lambda p: p.isNull() | p.startswith("/") | p.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(F.size(messages) == 0, "no messages")
        .when(~F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "unknown role")
        .when(tags != F.size(images), "image tags and images differ in number")
        .when(F.exists(images, absolute), "image path is not relative")
    )


def validate_sft(samples: DataFrame) -> DataFrame:
    """Add ``problem`` to samples with ``messages`` and ``images``."""
    return samples.withColumn("problem", sample_problem(F.col("messages"), F.col("images")))


def regions_to_sft(regions: DataFrame, image: Column, prompts: Mapping[str, str] = config.TASK_PROMPTS) -> DataFrame:
    """One sample per recognised region: its crop and the prompt of its task, answered by its content.

    ``regions`` carry ``task_type`` and ``content``; ``image`` is the relative path of the crop. Regions without content,
    or with a task that has no prompt, give none.
    """
    prompt = F.create_map(*[F.lit(x) for item in prompts.items() for x in item])
    asked = regions.withColumns({"_prompt": F.try_element_at(prompt, F.col("task_type")), "_image": image})
    usable = asked.where(F.col("_prompt").isNotNull() & (F.coalesce("content", F.lit("")) != ""))
    question = F.struct(F.lit("user").alias("role"), F.concat(F.lit(IMAGE_TAG), "_prompt").alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"))
    return usable.withColumns({"messages": F.array(question, answer), "images": F.array("_image")}).drop("_prompt", "_image")

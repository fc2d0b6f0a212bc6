"""Sections and headings of notes held in tables, and which section covers a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkboard.functions.markdown import parsed


def read(notes: DataFrame) -> DataFrame:
    """notes (path, text and others) with p: what is parsed of each. Null texts have no lines."""
    return notes.withColumn("p", parsed(F.col("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def sections(notes: DataFrame) -> DataFrame:
    """(note_id, ordinal, heading, line_start, line_end, text): physical lines, trimmed of blank ones; none without text."""
    return read(notes).select("note_id", F.posexplode("p.sections").alias("ordinal", "s")).select("note_id", "ordinal", "s.*")


def headings(notes: DataFrame) -> DataFrame:
    """(note_id, line, level, text) of each heading outside fences, those without text below too."""
    return read(notes).select("note_id", F.inline("p.headings"))


def covering(places: DataFrame, sections: DataFrame) -> DataFrame:
    """places (note_id, line and others) with the ordinal of the section that covers the line, null where none does. The join
    is on the note, so a line meets its own note's sections only."""
    held = sections.select(F.col("note_id").alias("_note"), "ordinal", "line_start", "line_end")
    return places.join(held, (F.col("note_id") == F.col("_note")) & F.col("line").between(F.col("line_start"), F.col("line_end")), "left").drop("_note", "line_start", "line_end")

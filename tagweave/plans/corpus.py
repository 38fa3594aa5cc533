"""The main pipelines as single plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators import runs, tags
from tagweave.operators.sampling import split_bernoulli
from tagweave.operators.scan import BLOCK
from tagweave.session import settle


def word_sections(words: DataFrame, mark: str = runs.TSHEG, max_rare: int = 100,
                  tag_maps: tuple[Mapping | DataFrame, Mapping | DataFrame] | None = None,
                  order: Sequence[str] = ("pos",), block: int | None = BLOCK) -> DataFrame:
    """Tagged words to sections of units with rare tags replaced: (doc_id, section_pos, words, tags).

    One running sum over the words numbers units and sections together. The units are stored once, as
    both the tag counts (one column of them) and the sections read them. With `block=None`, for words that lie
    together by document (see `scan.running`), they are made for each of the two instead: stored rows would lose
    their parts, and all of them would be moved to make the sections. Sections of punctuation only are dropped.
    """
    if tag_maps is not None:
        words = tags.map_tags(words, *tag_maps, salt_by=["doc_id", *order])
    units = runs.build_units(words, mark, order=order, block=block)
    if block is not None:
        units = settle(units)
    common = tags.replace_rare(units, max_rare)
    return runs.drop_punct_only(runs.build_sections(common, section="section_pos"))


def section_tag_counts(sections: DataFrame) -> DataFrame:
    """Tag frequency over the units of the sections."""
    return sections.select(F.explode("tags").alias("tag")).groupBy("tag").count()


def word_examples(sections: DataFrame, model, frac: float = 0.1, seed: int = 0) -> DataFrame:
    """Sections to training examples with a split: tokens per word, tags; bad alignments left out."""
    from tagweave.operators.tokens import align_tokens
    aligned = tags.drop_unaligned(align_tokens(sections, model)).drop("status", "words")
    named = aligned.select(F.concat_ws("-", "doc_id", "section_pos").alias("example_id"), "tokens", "tags")
    return split_bernoulli(named, frac, seed)

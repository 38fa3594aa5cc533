"""Tagging with a caller's model as an Arrow-batched job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.labels import strip_ends
from tagweave.functions.text import MARKS, literal
from tagweave.operators.runs import MASK
from tagweave.operators.tokens import UNDERLINE, Encoding, SubwordModel, encode

# A model takes id arrays and gives, for each, label ids (1-d) or scores (2-d: token, label).
Model = Callable[[list[np.ndarray]], Sequence[np.ndarray]]

_loaded: dict[str, Model] = {}


def predict(df: DataFrame, load: Callable[[], Model], name: str, tokens: str = "tokens",
            out: str = "predictions", batch_size: int = 64) -> DataFrame:
    """Label ids for every sequence. `load` is called once per Python worker under `name`.

    Inside an Arrow batch the sequences are ordered by length, so a batch pads little.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields),
                        f"`{out}` array<int>"])

    def run(batches):
        for batch in batches:
            if name not in _loaded:
                _loaded[name] = load()
            model = _loaded[name]
            rows = [np.asarray(row, dtype=np.int64) for row in batch[tokens]]
            answers: list[np.ndarray | None] = [None] * len(rows)
            by_length = np.argsort([len(r) for r in rows], kind="stable")
            for at in range(0, len(by_length), batch_size):
                chosen = by_length[at:at + batch_size]
                for i, answer in zip(chosen, model([rows[j] for j in chosen])):
                    answer = np.asarray(answer)
                    answers[i] = (answer.argmax(axis=1) if answer.ndim == 2 else answer).astype(np.int32)
            batch[out] = answers
            yield batch

    return df.mapInPandas(run, schema)


def wrapped(tokens: Column, bos: int, eos: int) -> Column:
    """Start and end ids added where they are not there yet."""
    first = F.when(F.try_element_at(tokens, F.lit(1)) == bos, tokens).otherwise(
        F.concat(F.array(F.lit(bos)), tokens))
    return F.when(F.try_element_at(first, F.lit(-1)) == eos, first).otherwise(F.concat(first, F.array(F.lit(eos))))


def wrap_specials(df: DataFrame, bos: int, eos: int, tokens: str = "tokens") -> DataFrame:
    return df.withColumn(tokens, wrapped(F.col(tokens), bos, eos))


def unwrap(df: DataFrame, predictions: str = "predictions") -> DataFrame:
    """Predictions without those of the start and end ids."""
    return df.withColumn(predictions, strip_ends(F.col(predictions)))


def predict_examples(df: DataFrame, load: Callable[[], Model], name: str, bos: int, eos: int,
                     tokens: str = "tokens", out: str = "predictions") -> DataFrame:
    """Wrap, predict, drop the first and the last prediction. Empty rows are left out.

    The predictions line up with `tokens` unless these already had the start or end id.
    """
    kept = df.filter(F.size(tokens) > 0).withColumn("__plain", F.col(tokens))
    done = unwrap(predict(wrap_specials(kept, bos, eos, tokens), load, name, tokens, out), out)
    return done.withColumn(tokens, F.col("__plain")).drop("__plain")


def grouped_words(tokens: Column, labels: Column, mask: str = MASK, keep_head: bool = False) -> Column:
    """Words of one bounded segment: array<struct<tokens, tag>>, each starting at a non-mask label.

    For label rows that are not bounded use `runs.words_from_tags`.
    """
    places = F.filter(F.transform(labels, lambda x, i: F.when(x != mask, i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(places, 2, F.size(labels)), F.array(F.size(labels)))
    words = F.transform(F.arrays_zip(places.alias("a"), ends.alias("b")), lambda p: F.struct(
        F.slice(tokens, p.getField("a") + 1, p.getField("b") - p.getField("a")).alias("tokens"),
        F.element_at(labels, p.getField("a") + 1).alias("tag")))
    none = F.size(places) == 0
    words = F.when(none, F.slice(F.array(F.struct(tokens.alias("tokens"), F.lit("").alias("tag"))), 1, 0)).otherwise(words)
    if not keep_head:
        return words
    first = F.coalesce(F.try_element_at(places, F.lit(1)), F.size(labels))
    head = F.array(F.struct(F.slice(tokens, 1, first).alias("tokens"), F.lit("").alias("tag")))
    return F.concat(head, words)


def window_ends(pieces: Sequence[str], limit: int, marks: Sequence[str] = MARKS) -> list[int]:
    """Where windows of at most `limit` tokens end: after a mark or before a word if there is one, else anywhere."""
    ends, start = [], 0
    while len(pieces) - start > limit:
        inside = range(start + limit, start, -1)
        after_mark = next((e for e in inside if pieces[e - 1].endswith(tuple(marks))), None) if marks else None
        before_word = next((e for e in inside if pieces[e].startswith(UNDERLINE)), None)
        start = after_mark or before_word or start + limit
        ends.append(start)
    return [*ends, len(pieces)] if len(pieces) > start or not ends else ends


def predict_windows(df: DataFrame, load: Callable[[], Model], name: str, bos: int, eos: int, max_length: int,
                    marks: Sequence[str] = MARKS, errors: str = "raise", out: str = "predictions",
                    batch_size: int = 64) -> DataFrame:
    """Label ids for all `tokens` of every row, long rows window by window.

    A window takes at most `max_length` tokens with the begin and end id that are put around it. With
    errors="default" the tokens of a window on which the model fails get the id -1.
    """
    if errors not in ("raise", "default") or max_length < 3:
        raise ValueError("errors is 'raise' or 'default', and max_length at least 3")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` array<int>"])

    def ids_of(answer) -> np.ndarray:
        answer = np.asarray(answer)
        return (answer.argmax(axis=1) if answer.ndim == 2 else answer).astype(np.int32)

    def run(batches):
        for batch in batches:
            if name not in _loaded:
                _loaded[name] = load()
            model = _loaded[name]
            windows, rows = [], []
            for row, (tokens, pieces) in enumerate(zip(batch["tokens"], batch["pieces"])):
                start = 0
                for end in window_ends(pieces, max_length - 2, marks):
                    windows.append(np.array([bos, *tokens[start:end], eos], np.int64))
                    rows.append(row)
                    start = end
            answers: list = [None] * len(windows)
            by_length = np.argsort([len(w) for w in windows], kind="stable")
            for at in range(0, len(by_length), batch_size):
                chosen = by_length[at:at + batch_size]
                try:
                    found = [ids_of(a) for a in model([windows[i] for i in chosen])]
                except Exception:
                    if errors == "raise":
                        raise
                    found = []
                    for i in chosen:  # one by one, so that a bad window spoils no other
                        try:
                            found.append(ids_of(model([windows[i]])[0]))
                        except Exception:
                            found.append(np.full(len(windows[i]), -1, np.int32))
                for i, answer in zip(chosen, found):
                    answers[i] = answer[1:-1]
            labels = [[] for _ in range(len(batch))]
            for row, answer in zip(rows, answers):
                labels[row].extend(answer.tolist())
            batch[out] = labels
            yield batch

    return df.mapInPandas(run, schema)


def tag_text(df: DataFrame, model: SubwordModel, load: Callable[[], Model], name: str, id_to_label: Mapping[int, str],
             text: str = "text", options: Encoding = Encoding(marks=MARKS), mask: str = MASK, keep_head: bool = False,
             max_length: int = 512, errors: str = "raise", default: str = "") -> DataFrame:
    """Words and tags of each whole text: adds `words` and `tags`.

    Texts of more than `max_length` tokens are tagged in windows, every token once. With errors="default" a window on
    which the model fails gets the label `default`; by default the failure is raised. `options` may not truncate or
    wrap, as the windows are wrapped here.
    """
    if options.max_length is not None or options.wrap:
        raise ValueError("tag_text cuts and wraps windows by itself: see max_length")
    coded = encode(df, model, text, options).drop("cut")
    specials = model.processor()
    done = predict_windows(coded, load, name, specials.PieceToId("[CLS]"), specials.PieceToId("[SEP]"), max_length,
                           options.marks, errors)
    names = F.create_map(*[F.lit(x) for pair in {**id_to_label, -1: default}.items() for x in pair])
    labels = F.transform("predictions", lambda p: F.element_at(names, p))
    grouped = done.withColumn("__labels", labels).withColumn(
        "__words", grouped_words(F.col("pieces"), F.col("__labels"), mask, keep_head))
    words = F.transform("__words.tokens", lambda w: F.trim(F.replace(F.array_join(w, ""), F.lit(UNDERLINE), F.lit(" "))))
    return grouped.select(*df.columns, words.alias("words"), F.col("__words.tag").alias("tags"))


def segments_by_mark(text: Column, max_chars: int, marks: Sequence[str] = MARKS) -> Column:
    """Cut a text after marks into the longest segments of at most `max_chars` characters.

    A stretch without a mark that is longer than that stays whole. One pass of a regular expression.
    """
    ends = "[" + "".join(literal(m) for m in marks) + "]"
    pattern = rf"(?s).{{1,{max_chars}}}(?:(?<={ends})|\z)|.+?(?:{ends}|\z)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tag_documents(df: DataFrame, segmenter: Callable[[Column], Column], preprocessors: Sequence[Callable[[Column], Column]],
                  model: SubwordModel, load: Callable[[], Model], name: str, id_to_label: Mapping[int, str],
                  doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Clean long texts, cut them into segments and tag each whole: (doc, seg, words, tags)."""
    cleaned = F.col(text)
    for step in preprocessors:
        cleaned = step(cleaned)
    segments = df.select(doc, F.posexplode(segmenter(cleaned)).alias("seg", text))
    return tag_text(segments, model, load, name, id_to_label, text, **options).drop(text)

"""Models to files: one at a time on the driver, many as tables of lines."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..nodes import Node
from ..plans.render import jump, latex
from ..plans.render.gams import model_lines
from ..plans.render.text import show, show_model
from .reader import Model, clean_lines, read_model


def write_gams(model: Model, path: str | None = None, form: bool = True) -> list[str]:
    """A model's lines, also written to a file if one is named."""
    lines = model_lines(model, form)
    if path:
        Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return lines


def write_latex(what: Model | Node, path: str | None = None, append: bool = False, standalone: bool | None = None, **options) -> str:
    """A document of a model or an equation; appended equations come without preamble unless asked for."""
    if isinstance(what, Node):
        text = latex.document(what, standalone=not append if standalone is None else standalone, **options)
    else:
        text = latex.model_document(what, **options)
    if path:
        with Path(path).open("a" if append else "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return text


def _jump(model: Model) -> list[str]:
    out = [jump.declaration(s) for s in model.symbols]
    for e in model.equations:
        if e.node is not None:
            out += jump.as_jump(e.node).split("\n")
    return out


def _print(model: Model) -> list[str]:
    return "\n".join([show_model(model), *(show(e.node) for e in model.equations if e.node is not None)]).split("\n")


FORMS = {"gams": model_lines, "latex": lambda model, **options: latex.model_document(model, **options).split("\n"), "jump": _jump, "print": _print}


def text_lines(texts: DataFrame, form: str = "gams", **options) -> DataFrame:
    """(model_id, ord, line) of many models (model_id, text): `gams`, `latex`, `jump` and `print` rendered anew, `interim` the cleaned source.

    `options` are those of latex.model_document().
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, order, lines = [], [], []
            for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if form == "interim":
                    own = clean_lines((t or "").split("\n"))
                else:
                    model = read_model(t or "", m)
                    own = FORMS[form](model, **options)
                ids += [m] * len(own)
                order += range(len(own))
                lines += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(order, pa.int32()), pa.array(lines, pa.string())], ["model_id", "ord", "line"])

    if form != "interim" and form not in FORMS:
        raise ValueError(f"no form {form!r}")
    return texts.select(F.col("model_id").cast("string"), F.col("text").cast("string")).mapInArrow(render, "model_id string, ord int, line string")


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text files of lines (model_id, ord, line), in order, in a folder per model."""
    lines.repartition("model_id").sortWithinPartitions("model_id", "ord").select("model_id", "line").write.mode(mode).partitionBy("model_id").text(path)

"""Plug-in model detector (U1): the one place a Python worker runs.

``mapInPandas`` hands Arrow batches of ``(key, text)`` to a model loaded lazily once per Python
worker (a module-level cache), in batches of ``batch_size`` rows, and returns span arrays.  Any
model with ``predict(texts) -> list[list[(start, end, label)]]`` fits; none is bundled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_MODELS: dict = {}

OUT_SCHEMA = "{key} long, spans array<struct<start:int,end:int,label:string,src:string>>"


def _model(factory, name):
    m = _MODELS.get(name)
    if m is None:
        m = _MODELS[name] = factory()
    return m


def detect_with_model(df: DataFrame, key: str, text: str, factory, name: str = "model", batch_size: int = 512) -> DataFrame:
    """Spans predicted by an outside model for every row; rows keep their partitioning."""
    import pandas as pd

    def run(batches):
        model = _model(factory, name)
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i:i + batch_size]
                texts = part[text].fillna("").tolist()
                preds = model.predict(texts)
                spans = [[{"start": int(s), "end": int(e), "label": str(lab), "src": name} for s, e, lab in p] for p in preds]
                yield pd.DataFrame({key: part[key].astype("int64").values, "spans": spans})

    return df.select(key, text).mapInPandas(run, OUT_SCHEMA.format(key=key))

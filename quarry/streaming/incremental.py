"""Incremental models on a stream: every micro-batch is one call of ``partial_fit``."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.base import load_model


def _store(spark, path: str, text: str) -> None:
    """The text as a file under the path, written apart and then renamed, so readers see one whole file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".draft"))
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def _stored(spark, path: str) -> str | None:
    """The text under the path; its draft, where a writer stopped between removing one and renaming the other."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in (path, path + ".draft"):
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            stream = fs.open(at)
            try:
                return bytes(stream.readAllBytes()).decode("utf-8")
            finally:
                stream.close()
    return None


def fit_stream(model, stream: DataFrame, features: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Fits the model on every micro-batch and keeps its JSON with the number of the batch at checkpoint/model.json.

    After a restart the stored model goes on; a batch that it has already seen is not
    counted twice.  Empty batches change nothing.  The model in hand is updated as well.
    """
    spark = stream.sparkSession
    path = str(PurePosixPath(checkpoint) / "model.json") if "://" not in checkpoint else checkpoint.rstrip("/") + "/model.json"
    seen = -1
    kept = _stored(spark, path)
    if kept:
        number, _, text = kept.partition("\n")
        seen = int(number)
        vars(model).update(vars(load_model(text)))
    state = {"seen": seen}

    def step(batch: DataFrame, number: int) -> None:
        if number <= state["seen"]:
            return
        if not batch.isEmpty():
            model.partial_fit(batch, features)
            _store(spark, path, f"{number}\n{model.to_json()}")
        state["seen"] = number

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

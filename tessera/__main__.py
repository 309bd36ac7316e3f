"""Command line: ``python -m tessera train|predict|quantize|demo``."""

from __future__ import annotations

import argparse
import os

from .plans.predictor import Predictor
from .session import local_session
from .sources import io


def _frames(spark, folder: str | None) -> dict:
    """Modality tables (Parquet) in a folder, or the sample patient."""
    if folder is None:
        return io.sample_input(spark)
    found = {m: io.load(spark, f"{folder}/{m}.parquet") for m in ("tabular", "temporal", "image", "text") if os.path.exists(f"{folder}/{m}.parquet")}
    if not found:
        raise SystemExit(f"no modality table in {folder}")
    return found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    train = sub.add_parser("train", help="fit on (doc_id, text, label), or on the sample sentences")
    train.add_argument("--data", help="Parquet of doc_id, text, label")
    train.add_argument("--model", required=True)
    train.add_argument("--epochs", type=int, default=100)
    predict = sub.add_parser("predict", help="score modality tables and write JSON")
    predict.add_argument("--model", required=True)
    predict.add_argument("--input", help="folder of tabular, temporal, image and text .parquet, keyed by id")
    predict.add_argument("--output", required=True)
    quantize = sub.add_parser("quantize", help="flag a model")
    quantize.add_argument("--model", required=True)
    sub.add_parser("demo", help="train on samples and score the sample patient")
    args = p.parse_args(argv)
    spark = local_session(app="tessera")
    if args.command == "train":
        docs = io.load(spark, args.data) if args.data else io.sample_text(spark)
        Predictor().train(docs, args.epochs).save(spark, args.model)
    elif args.command == "predict":
        out = Predictor.load(spark, args.model).predict(_frames(spark, args.input))
        io.write_predictions(out, args.output, "id")
        out.show()
    elif args.command == "quantize":
        Predictor.load(spark, args.model).quantize().save(spark, args.model)
    else:
        Predictor().train(io.sample_text(spark, 10), 10).predict(_frames(spark, None)).show()


if __name__ == "__main__":
    main()

"""The jobs as commands, for spark-submit or ``python -m pairforge``.

Models are given as ``module:function``; the function takes nothing and returns
a function from a list of texts to a list of texts (or vectors).
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pairforge.plans import (
    cluster_pairs,
    filter_pairs,
    generate,
    make_splits,
    parallel_text,
    profile_corpora,
    sts,
)
from pairforge.runtime import session
from pairforge.sources.readers import read_jsonl, with_row_number


def loader(name: str) -> Callable:
    module, _, function = name.partition(":")

    def load():
        return getattr(importlib.import_module(module), function)()

    return load


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairforge")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *positional: str, model: bool = False) -> argparse.ArgumentParser:
        added = jobs.add_parser(name)
        for argument in positional:
            added.add_argument(argument)
        if model:
            added.add_argument("--model", type=loader, required=True)
        return added

    p = job("translate", "foreign_path", "native_path", "output_path", model=True)
    p.add_argument("--num_examples", type=int)
    p.add_argument("--trim_word_count", type=int)

    p = job("cluster-pairs", "table", "output_path")
    p.add_argument("--language", default="pt")

    p = job("filter", "input_path", "output_path", model=True)
    p.add_argument("--prune_threshold", type=float, default=0.5)
    p.add_argument("--semantic_threshold", type=float, default=0.8)

    p = job("make-splits", "input_path", "output_path")
    p.add_argument("--num_samples", type=int, default=300_000)

    p = job("profile", "output_path")
    p.add_argument("--corpus", action="append", required=True, metavar="NAME=PATH", help="JSON lines; may repeat")
    p.add_argument("--positive", action="append", default=[], metavar="NAME=SOURCE,TARGET[,LABEL]")
    p.add_argument("--sample", type=int)

    p = job("generate", "output_path", model=True)
    p.add_argument("--file")
    p.add_argument("--dataset")
    p.add_argument("--config")
    p.add_argument("--split")
    p.add_argument("--delimiter")
    p.add_argument("--remove_bad_chars", action="store_true")
    p.add_argument("--max_samples", type=int)
    p.add_argument("--filter", dest="predicate")
    p.add_argument("--map", dest="mapping")
    p.add_argument("--source_column", default="source")
    p.add_argument("--target_column", default="target")
    p.add_argument("--prefix", default="")
    p.add_argument("--batch_size", type=int, default=16)

    p = job("score", "input_path", "output_path")
    p.add_argument("--metric", default="generation")
    p.add_argument("--source_column")
    p.add_argument("--target_column")
    p.add_argument("--predictions_column")
    p.add_argument("--lower_case", action="store_true")
    p.add_argument("--model", type=loader, help="vectors for the mean cosine")

    job("sts", "xml_path", model=True)
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = session(f"pairforge {a.job}")
    if a.job == "translate":
        parallel_text.run(
            spark, a.foreign_path, a.native_path, a.output_path, a.model,
            a.num_examples, a.trim_word_count,
        )
    elif a.job == "cluster-pairs":
        cluster_pairs.run(spark, a.table, a.output_path, a.language)
    elif a.job == "filter":
        counts = filter_pairs.run(
            spark, a.input_path, a.output_path, a.model, a.prune_threshold, a.semantic_threshold
        )
        for step, rows in counts.items():
            print(f"{step}: {rows}")
    elif a.job == "make-splits":
        make_splits.run(spark, a.input_path, a.output_path, a.num_samples)
    elif a.job == "profile":
        corpora = {}
        labelled = dict(item.split("=", 1) for item in a.positive)
        for name, path in (item.split("=", 1) for item in a.corpus):
            pairs = with_row_number(read_jsonl(spark, path, None))
            if name in labelled:
                pairs = profile_corpora.positive_pairs(pairs, *labelled[name].split(","), keep=("pair_id",))
            corpora[name] = pairs
        profile_corpora.run(spark, corpora, a.output_path, a.sample)
        spark.read.json(f"{a.output_path}/means").show(truncate=False)
    elif a.job == "generate":
        generate.prepare_and_generate(
            spark, a.output_path, a.model,
            file=a.file, dataset=a.dataset, config=a.config, split=a.split,
            delimiter=a.delimiter, remove_bad_chars=a.remove_bad_chars,
            max_samples=a.max_samples, predicate=a.predicate, mapping=a.mapping,
            source=a.source_column, target=a.target_column,
            prefix=a.prefix, batch_size=a.batch_size,
        )
    elif a.job == "score":
        generate.run_score(
            spark, a.input_path, a.output_path,
            metric=a.metric, source=a.source_column, target=a.target_column,
            prediction=a.predictions_column, lower_case=a.lower_case, load=a.model,
        ).show(truncate=False)
    elif a.job == "sts":
        sts.run(spark, a.xml_path, a.model).show()


if __name__ == "__main__":
    main()

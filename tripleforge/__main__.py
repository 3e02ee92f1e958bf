"""python -m tripleforge extract | augment | convert | visualize | run | clean-ocr | list: pipelines by file or by flags."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .clients import available_clients
from .operators import graph
from .plans.domains import list_domains
from .plans.pipeline import first_errors, list_pipelines, list_steps, load_config, run_config, summary
from .sources import readers, writers

#: The steps that a flag of the run command stands for.
FLAGS = {"extract": ["extract"], "augment": ["augment"], "convert": ["convert"], "visualize": ["visualize-network", "visualize-extraction"]}


def _inputs(command: argparse.ArgumentParser, domain: bool, client: str | None = None) -> None:
    command.add_argument("--input", "-i", "--input-file", required=domain)
    command.add_argument("--output-dir", "-o")
    command.add_argument("--domain", "-d", required=domain)
    command.add_argument("--mode", "-m", choices=("open", "constrained"))
    command.add_argument("--domain-folder", help="a folder to read the domain from")
    command.add_argument("--client", "-c", default=client)
    command.add_argument("--model")
    command.add_argument("--api-key")
    command.add_argument("--base-url")
    command.add_argument("--temp", type=float)
    command.add_argument("--timeout", type=int)
    command.add_argument("--workers", type=int)
    command.add_argument("--text-field")
    command.add_argument("--id-field")
    command.add_argument("--record-ids", nargs="+")
    command.add_argument("--limit", "-l", type=int)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tripleforge")
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="triples of records, as JSON")
    _inputs(extract, True, "gemini")
    extract.add_argument("--prompt", help="a file that takes the place of the extraction's prompt")
    augment = commands.add_parser("augment", help="refine saved triples; records without any are extracted")
    augment.add_argument("strategy", choices=("connectivity", "entity_resolution"))
    _inputs(augment, True, "gemini")
    augment.add_argument("--max-disconnected", type=int, default=3)
    augment.add_argument("--max-iterations", type=int, default=2)
    convert = commands.add_parser("convert", help="a folder of triples to GraphML")
    convert.add_argument("--input", "-i", required=True)
    convert.add_argument("--output-dir", "-o")
    show = commands.add_parser("visualize", help="pages of graphs or of texts")
    show.add_argument("what", choices=("network", "extraction"))
    show.add_argument("--input", "-i", required=True, help="network: a folder of GraphML; extraction: the records")
    show.add_argument("--triples", help="extraction: the folder of triples")
    show.add_argument("--output-dir", "-o")
    show.add_argument("--text-field", default="text")
    show.add_argument("--id-field", default="id")
    show.add_argument("--group-by", choices=("entity_type", "relation"), default="entity_type")
    show.add_argument("--dark-mode", action="store_true")
    show.add_argument("--layout", choices=("spring", "circle"), default="spring")
    run = commands.add_parser("run", aliases=["run-pipeline"], help="a pipeline file, or the steps that flags name")
    run.add_argument("file", nargs="?")
    run.add_argument("--config", "-f")
    _inputs(run, False)
    for flag in FLAGS:
        run.add_argument(f"--{flag}", action="store_true")
    clean = commands.add_parser("clean-ocr", help="repair the broken words of a JSONL file")
    clean.add_argument("input")
    clean.add_argument("output", nargs="?")
    commands.add_parser("list").add_argument("what", choices=("domains", "clients", "steps", "pipelines"))
    return parser


def to_raw(got: argparse.Namespace, raw: dict) -> dict:
    """raw, a pipeline, with what the flags say in the place of what it says."""
    client = {"type": got.client, "model": got.model, "api_key": got.api_key, "base_url": got.base_url, "temperature": got.temp, "timeout": got.timeout, "workers": got.workers}
    source = {"file": got.input, "text_field": got.text_field, "id_field": got.id_field, "record_ids": got.record_ids, "limit": got.limit}
    top = {"domain": got.domain, "mode": got.mode, "output_dir": got.output_dir, "domain_folder": got.domain_folder}
    said = lambda d: {k: v for k, v in d.items() if v is not None}
    return raw | said(top) | {"client": (raw.get("client") or {}) | said(client), "input": (raw.get("input") or {}) | said(source)}


def _pipeline(got: argparse.Namespace) -> dict:
    if got.command == "extract":
        return to_raw(got, {"output_dir": "outputs/graphs", "steps": ["extract", "export-json"], "prompt": got.prompt})
    if got.command == "augment":
        options = {"max_disconnected": got.max_disconnected, "max_iterations": got.max_iterations} if got.strategy == "connectivity" else {}
        raw = to_raw(got, {"output_dir": "outputs/graphs", "steps": [{"augment": {"strategy": got.strategy, **options}}, "export-json"]})
        saved = os.path.join(raw["output_dir"], "json")
        return raw | ({"triples": saved} if os.path.isdir(saved) else {})
    file = got.config or got.file
    if file:
        return to_raw(got, load_config(file))
    steps = [s for flag, names in FLAGS.items() if getattr(got, flag) for s in names]
    if not steps:
        raise SystemExit("name a pipeline file, or one of --" + ", --".join(FLAGS))
    if not got.input or not got.domain:
        raise SystemExit("--input and --domain are needed without a pipeline file")
    return to_raw(got, {"steps": [*steps, "export-json"], "client": {"type": "gemini"}})


def main(args: list[str] | None = None) -> int:
    got = _parser().parse_args(args)
    if got.command == "list":
        if got.what == "pipelines":
            print("\n".join(f"{name}: {about}" if about else name for name, about in list_pipelines()))
        else:
            print("\n".join({"domains": list_domains, "clients": available_clients, "steps": list_steps}[got.what]()))
        return 0
    raw = None if got.command in ("convert", "visualize", "clean-ocr") else _pipeline(got)
    spark = SparkSession.builder.appName("tripleforge").getOrCreate()
    if got.command == "clean-ocr":
        print(readers.clean_ocr_jsonl(spark, got.input, got.output))
        return 0
    if got.command == "convert":
        table = writers.graphml(*graph.graph(readers.read_triples(spark, got.input)))
        writers.write_files(table, got.output_dir or os.path.join(os.path.dirname(os.path.normpath(got.input)), "graphml"), ".graphml")
        return 0
    if got.command == "visualize":
        if got.what == "network":
            nodes, edges = readers.read_graphml(spark, got.input)
            pages = writers.network_pages(graph.view(nodes, edges), got.dark_mode, got.layout)
        else:
            from .operators.triples import entity_spans, normalize

            if not got.triples:
                raise SystemExit("--triples names the folder of triples")
            records = readers.load_records(readers.read_table(spark, got.input), got.text_field, got.id_field)
            triples = normalize(readers.read_triples(spark, got.triples))
            pages = writers.text_pages(records, triples, entity_spans(triples, records, got.group_by), got.dark_mode)
        writers.write_files(pages, got.output_dir or os.path.join(os.path.normpath(got.input) if os.path.isdir(got.input) else os.path.dirname(got.input), "visualizations"), ".html")
        return 0
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise SystemExit("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    state = run_config(spark, raw)
    row = summary(state).first()
    print(f"{row.n_records} records, {row.n_failed} failed, {row.n_triples} triples")
    for failed in first_errors(state).orderBy(F.col("record_id")).take(20):
        print(f"{failed.record_id}: {failed.step}: {failed.message}")
    return int(row.n_failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())

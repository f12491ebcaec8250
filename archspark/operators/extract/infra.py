"""Deployment and manifest facts: Docker, Compose, Kubernetes and package manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.operators.extract.facts import Extraction, file_nodes
from archspark.operators.graph import attr_struct, edge_frame, node_frame, ref_frame, union_all
from archspark.schema import KEYS
from archspark.sources.tree import read_manifests

# Image name part to kind and technology.
IMAGES = (
    ("postgres", "database", "PostgreSQL"), ("mysql", "database", "MySQL"), ("mariadb", "database", "MariaDB"),
    ("mongo", "database", "MongoDB"), ("redis", "database", "Redis"), ("elasticsearch", "database", "Elasticsearch"),
    ("cassandra", "database", "Cassandra"), ("clickhouse", "database", "ClickHouse"), ("rabbitmq", "queue", "RabbitMQ"),
    ("kafka", "queue", "Kafka"), ("zookeeper", "queue", "ZooKeeper"), ("nats", "queue", "NATS"), ("nginx", "component", "NGINX"),
    ("traefik", "component", "Traefik"), ("haproxy", "component", "HAProxy"), ("minio", "data_store", "MinIO"),
    ("vault", "component", "Vault"), ("keycloak", "component", "Keycloak"),
)
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ReplicaSet", "Pod")


def classify_image(image: Column) -> tuple[Column, Column]:
    """(kind, technology) of the first known part of the image name."""
    low = F.lower(F.coalesce(image, F.lit("")))
    kind, label = F.lit("container"), F.coalesce(F.nullif(image, F.lit("")), F.lit("container"))
    for token, k, name in reversed(IMAGES):
        kind, label = F.when(low.contains(token), k).otherwise(kind), F.when(low.contains(token), name).otherwise(label)
    return kind, label


def _load_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML documents as JSON text; what they mean is read in Spark."""
    import json

    import yaml  # a cluster without it fails here rather than finding fewer containers

    def load(text: str):
        try:
            docs = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
            return [json.dumps(d, default=str) for d in docs], ""
        except Exception as exc:  # one file never stops the job
            return [], f"manifest parse error ({type(exc).__name__})"

    for batch in batches:
        loaded = [load(t) for t in batch["text"]]
        out = batch.drop(columns=["text"]).reset_index(drop=True)
        out["docs"], out["error"] = [d for d, _ in loaded], [e for _, e in loaded]
        yield out


def yaml_documents(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = files.select(*keys, "path", "module", "infra_kind", "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema.fields if f.name != "text")
    return staged.mapInPandas(_load_yaml, f"{kept}, docs array<string>, error string")


def _file_id() -> Column:
    return F.concat(F.lit("file:"), F.col("path"))


def _text_list(json: Column) -> Column:
    """A JSON list as strings, scalars included."""
    return F.coalesce(F.from_json(json, "array<string>"), F.expr("cast(array() as array<string>)"))


def dockerfiles(files: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    text = F.col("text")
    docker = files.filter(F.col("infra_kind") == "docker")
    service = F.when(F.col("module") != "(root)", F.col("module")).otherwise("app")
    ports = F.filter(F.flatten(F.transform(
        F.regexp_extract_all(text, F.lit(r"(?mi)^\s*EXPOSE\s+([0-9\s]+)"), F.lit(1)), lambda p: F.split(p, r"\s+"))), lambda p: p != "")
    images = F.regexp_extract_all(text, F.lit(r"(?mi)^\s*FROM\s+([^\s]+)"), F.lit(1))
    entry = F.trim(F.regexp_extract(text, r"(?mi)^\s*(?:ENTRYPOINT|CMD)\s+(.+)$", 1))
    node_id = F.concat(F.lit("container:"), service)
    nodes = node_frame(
        docker, keys,
        attr=attr_struct(extra=F.create_map(
            F.lit("base_images"), F.to_json(images), F.lit("ports"), F.to_json(ports), F.lit("entrypoint"), entry,
            F.lit("origin"), F.lit("dockerfile"))),
        id=node_id, kind=F.lit("container"), name=service, qualified_name=service, file=F.col("path"), module=F.col("module"),
        language=F.lit("docker"),
    )
    return nodes, edge_frame(docker, keys, source=_file_id(), target=node_id, kind=F.lit("deploys"))


def compose_services(docs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    first = docs.filter((F.col("infra_kind") == "compose") & (F.size("docs") > 0)).select(
        *keys, "path", "module", F.explode(F.from_json(F.get_json_object(F.col("docs")[0], "$.services"), "map<string,string>")).alias("name", "spec"))
    spec = lambda p: F.get_json_object("spec", p)
    image = F.coalesce(spec("$.image"), F.lit(""))
    kind, label = classify_image(F.when(image != "", image).otherwise(F.col("name")))
    env = spec("$.environment")
    env_keys = F.when(env.startswith("{"), F.map_keys(F.from_json(env, "map<string,string>"))).otherwise(
        F.transform(_text_list(env), lambda e: F.element_at(F.split(e, "="), 1)))
    first = first.withColumns({"image": image, "kind": kind, "label": label})
    node_id = F.concat(F.lit("container:"), F.col("name"))
    nodes = node_frame(
        first, keys,
        attr=attr_struct(
            technology=F.col("label"),
            extra=F.create_map(
                F.lit("image"), F.col("image"), F.lit("ports"), F.to_json(_text_list(spec("$.ports"))),
                F.lit("environment_keys"), F.to_json(F.array_sort(F.coalesce(env_keys, F.expr("cast(array() as array<string>)")))),
                F.lit("replicas"), F.coalesce(spec("$.deploy.replicas"), F.lit("1")), F.lit("origin"), F.lit("compose"))),
        id=node_id, kind=F.col("kind"), name=F.col("name"), qualified_name=F.col("name"), file=F.col("path"),
        module=F.col("module"), language=F.lit("docker"),
    )
    depends = spec("$.depends_on")
    names = F.when(depends.startswith("{"), F.map_keys(F.from_json(depends, "map<string,string>"))).otherwise(_text_list(depends))
    wanted = first.select(*keys, "path", "name", F.explode(F.transform(
        F.concat(names, _text_list(spec("$.links"))), lambda d: F.element_at(F.split(d, ":"), 1))).alias("other"))
    known = first.select(*keys, "path", F.col("name").alias("other")).distinct()
    talk = wanted.join(known, [*keys, "path", "other"], "left_semi")
    return nodes, edge_frame(first, keys, source=_file_id(), target=node_id, kind=F.lit("deploys")).unionByName(edge_frame(
        talk, keys, attr=F.create_map(F.lit("via"), F.lit("compose")), source=node_id,
        target=F.concat(F.lit("container:"), F.col("other")), kind=F.lit("communicates_with")))


def kubernetes_objects(docs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = docs.filter(~F.col("infra_kind").isin("compose", "helm", "serverless")).select(*keys, "path", "module", F.explode("docs").alias("doc"))
    get = lambda p: F.get_json_object("doc", p)
    rows = rows.filter(get("$.apiVersion").isNotNull()).withColumns({
        "object": get("$.kind"), "name": F.coalesce(get("$.metadata.name"), F.lit("unnamed"))})
    node_id = F.concat(F.lit("k8s:"), F.col("object"), F.lit(":"), F.col("name"))
    images = F.transform(F.coalesce(F.from_json(get("$.spec.template.spec.containers"), "array<struct<image:string>>"),
                                    F.expr("cast(array() as array<struct<image:string>>)")), lambda c: F.coalesce(c["image"], F.lit("")))
    work = rows.filter(F.col("object").isin(*WORKLOADS)).withColumn("images", images)
    kind, label = classify_image(F.coalesce(F.try_element_at("images", F.lit(1)), F.col("name")))
    common = dict(id=node_id, name=F.col("name"), qualified_name=F.concat("object", F.lit("/"), "name"), file=F.col("path"),
                  module=F.col("module"), language=F.lit("kubernetes"))
    work_nodes = node_frame(
        work, keys,
        attr=attr_struct(technology=label, extra=F.create_map(
            F.lit("workload"), F.col("object"), F.lit("images"), F.to_json("images"), F.lit("image"), F.coalesce(F.try_element_at("images", F.lit(1)), F.lit("")),
            F.lit("replicas"), F.coalesce(get("$.spec.replicas"), F.lit("1")),
            F.lit("namespace"), F.coalesce(get("$.metadata.namespace"), F.lit("default")), F.lit("origin"), F.lit("kubernetes"))),
        kind=kind, **common)
    front = rows.filter(F.col("object").isin("Service", "Ingress"))
    ports = F.transform(F.filter(F.coalesce(F.from_json(get("$.spec.ports"), "array<struct<port:string>>"),
                                            F.expr("cast(array() as array<struct<port:string>>)")), lambda p: p.isNotNull()), lambda p: p["port"])
    front_nodes = node_frame(
        front, keys,
        attr=attr_struct(extra=F.create_map(
            F.lit("workload"), F.col("object"), F.lit("type"), F.coalesce(get("$.spec.type"), F.lit("")), F.lit("ports"), F.to_json(ports),
            F.lit("origin"), F.lit("kubernetes"))),
        kind=F.lit("component"), **common)
    edges = edge_frame(work.select(*rows.columns).union(front), keys, source=_file_id(), target=node_id, kind=F.lit("deploys"))
    refs = ref_frame(
        front.filter(get("$.spec.selector.app").isNotNull()), keys, source_id=node_id, target_name=get("$.spec.selector.app"),
        kind=F.lit("communicates_with"), language=F.lit("kubernetes"))
    return work_nodes.unionByName(front_nodes), edges, refs


# Dependency patterns of manifests.
GO_MOD = r"(?m)^\s*([\w.\-/]+)\s+v[\w.\-+]+"
GRADLE = r"""(?:implementation|api|compile)\s*[('"]+([\w.\-:]+)"""
MAVEN = r"(?s)<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>"


def extract_dependencies(files: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """External packages of manifests: package nodes, module nodes, and module-depends-on-package edges."""
    text, kind = F.col("text"), F.col("infra_kind")
    name = F.element_at(F.split("path", "/"), -1)
    none = F.expr("cast(array() as array<struct<name:string,version:string>>)")
    plain = lambda names: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("version")))
    part = lambda p: F.coalesce(F.from_json(F.get_json_object(text, p), "map<string,string>"), F.create_map().cast("map<string,string>"))
    dev, prod = part("$.devDependencies"), part("$.dependencies")
    merged = F.map_concat(F.map_filter(prod, lambda k, _: ~F.map_contains_key(dev, k)), dev)
    npm = F.transform(F.map_entries(merged), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version")))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), F.trim), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    required = F.transform(lines, lambda x: F.trim(F.element_at(F.split(x, r"[<>=!~;\[]"), 1)))
    project = F.regexp_extract_all(F.regexp_extract(text, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r'"([A-Za-z0-9_\-\[\].]+)'), F.lit(1))
    cargo = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[dependencies\](.*?)(?:\n\[|\z)", 1), F.lit(r"(?m)^\s*([A-Za-z0-9_\-]+)\s*="), F.lit(1))
    maven = F.transform(F.regexp_extract_all(text, F.lit(MAVEN), F.lit(0)), lambda d: F.concat(
        F.regexp_extract(d, MAVEN, 1), F.lit(":"), F.regexp_extract(d, MAVEN, 2)))
    packages = (
        F.when(kind == "npm", npm)
        .when((kind == "pip") & (name == "pyproject.toml"), plain(project)).when(kind == "pip", plain(required))
        .when(kind == "gomod", plain(F.regexp_extract_all(text, F.lit(GO_MOD), F.lit(1))))
        .when(kind == "cargo", plain(cargo)).when(kind == "maven", plain(maven))
        .when(kind == "gradle", plain(F.regexp_extract_all(text, F.lit(GRADLE), F.lit(1)))).otherwise(none)
    )
    language = F.when(kind == "npm", "javascript").when(kind == "pip", "python").when(kind == "cargo", "rust").when(
        kind == "maven", "java").otherwise(F.col("language"))
    staged = files.filter(kind.isin("npm", "pip", "gomod", "cargo", "maven", "gradle"))
    bad = staged.filter((kind == "npm") & F.get_json_object(text, "$").isNull()).select(
        *keys, "path", F.lit("manifest parse error (JSONDecodeError)").alias("warning"))
    staged = staged.withColumns({"mod_language": language, "packages": packages})
    rows = staged.select(*keys, "module", "mod_language", F.explode("packages").alias("p")).select(
        *keys, "module", "mod_language", "p.*").filter("name <> ''")
    extra = F.when(kind == "npm", F.create_map(
        F.lit("package_name"), F.coalesce(F.get_json_object(text, "$.name"), F.lit("")),
        F.lit("scripts"), F.to_json(F.map_keys(part("$.scripts"))))).otherwise(F.create_map().cast("map<string,string>"))
    modules = node_frame(
        staged, keys, attr=attr_struct(extra=extra), id=F.concat(F.lit("module:"), F.col("module")), kind=F.lit("module"),
        name=F.element_at(F.split("module", "/"), -1), qualified_name=F.col("module"), module=F.col("module"), language=F.col("mod_language"))
    ext_id = F.concat(F.lit("ext:"), F.col("name"))
    version = F.when(F.col("version") != "", F.create_map(F.lit("version"), F.col("version"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = node_frame(
        rows.groupBy(*keys, "name").agg(F.min("mod_language").alias("mod_language"), F.max("version").alias("version")), keys,
        attr=attr_struct(extra=version), id=ext_id, kind=F.lit("external_package"), name=F.col("name"), qualified_name=F.col("name"),
        language=F.col("mod_language"), external=F.lit(True))
    edges = edge_frame(rows, keys, attr=version, source=F.concat(F.lit("module:"), F.col("module")), target=ext_id, kind=F.lit("depends_on"))
    return modules.unionByName(nodes), edges, bad


def extract_infra(files: DataFrame, keys: Sequence[str] = KEYS) -> Extraction:
    """All deployment and manifest facts; a manifest that does not parse yields a warning."""
    text = F.col("text")
    rows = read_manifests(files).withColumns({
        "size": F.octet_length(text).cast("long"),
        "loc": F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1})
    file_rows, contains = file_nodes(rows.select(*keys, "path", "module", "language", "size", "loc"), keys)
    wanted = (F.col("infra_kind") == "compose") | (
        (F.col("language") == "yaml") & (F.col("infra_kind") == "") & text.contains("apiVersion") & text.contains("kind"))
    docs = yaml_documents(rows.filter(wanted), keys)
    docker, docker_edges = dockerfiles(rows, keys)
    compose, compose_edges = compose_services(docs, keys)
    k8s, k8s_edges, k8s_refs = kubernetes_objects(docs, keys)
    packages, package_edges, bad = extract_dependencies(rows, keys)
    warnings = docs.filter("error <> ''").select(*keys, "path", F.col("error").alias("warning")).unionByName(bad)
    return Extraction(
        nodes=union_all(file_rows, docker, compose, k8s, packages),
        edges=union_all(contains, docker_edges, compose_edges, k8s_edges, package_edges), refs=k8s_refs, warnings=warnings,
    )

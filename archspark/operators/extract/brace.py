"""Facts of brace languages: JavaScript and TypeScript, Java and C#, Go, Rust, C and C++.

Headers are regular expressions over the text without comments; a body runs to the
matching brace.  All of it is in-row, so a family is a scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions import matching as mt
from archspark.functions.frames import first_match
from archspark.functions.text import strip_comments
from archspark.operators.extract.facts import fact_rows, prepare, qualify, register_extractor

NO_STRINGS = "cast(array() as array<string>)"


def _staged(files: DataFrame, languages: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return prepare(files, languages, keys).withColumn("text", strip_comments(F.col("text")))


def _all(pattern: str, index: int, text: Column | None = None) -> Column:
    return F.regexp_extract_all(F.col("text") if text is None else text, F.lit(pattern), F.lit(index))


def _strings() -> Column:
    return F.expr(NO_STRINGS)


def _member(name: Column, visibility: Column, returns: Column | None = None, static: Column | None = None) -> Column:
    blank = F.lit("")
    return F.struct(
        name.alias("name"), visibility.alias("visibility"), (blank if returns is None else returns).alias("returns"),
        F.expr("cast(array() as array<struct<name:string,type:string>>)").alias("params"),
        (F.lit(False) if static is None else static).alias("is_static"), F.lit(False).alias("is_abstract"),
        F.lit(False).alias("is_async"),
    )


def _property(name: Column, kind: Column, visibility: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), visibility.alias("visibility"))


METHODS = "cast(array() as array<struct<name:string,visibility:string,returns:string,params:array<struct<name:string,type:string>>,is_static:boolean,is_abstract:boolean,is_async:boolean>>)"
PROPERTIES = "cast(array() as array<struct<name:string,type:string,visibility:string>>)"


def _type(name, kind, line, *, qualified=None, stereotype=None, bases=None, composes=None, calls=None, methods=None,
          properties=None, members=None, is_orm=None) -> Column:
    none = F.lit(None)
    return F.struct(
        name.alias("name"), kind.alias("kind"), (qualify(name) if qualified is None else qualified).alias("qualified"),
        line.alias("line"), (F.lit("") if stereotype is None else stereotype).alias("stereotype"), F.lit("").alias("docstring"),
        (F.expr("cast(array() as array<struct<name:string,kind:string>>)") if bases is None else bases).alias("bases"),
        (_strings() if composes is None else composes).alias("composes"), (_strings() if calls is None else calls).alias("calls"),
        (F.expr(METHODS) if methods is None else methods).alias("methods"),
        (F.expr(PROPERTIES) if properties is None else properties).alias("properties"),
        (_strings() if members is None else members).alias("members"), none.cast("string").alias("table"),
        (F.lit(False) if is_orm is None else is_orm).alias("is_orm"),
    )


def _function(name, line, *, qualified=None, owner=None, params=None, returns=None, visibility=None, calls=None) -> Column:
    return F.struct(
        name.alias("name"), (qualify(name) if qualified is None else qualified).alias("qualified"),
        (F.lit("") if owner is None else owner).alias("owner"), line.alias("line"),
        (F.lit(None).cast("array<struct<name:string,type:string>>") if params is None else params).alias("params"),
        (F.lit("") if returns is None else returns).alias("returns"),
        (F.lit("public") if visibility is None else visibility).alias("visibility"), F.lit(False).alias("is_async"),
        F.lit("").alias("docstring"), F.lit(None).cast("int").alias("complexity"),
        F.transform(_strings() if calls is None else calls, lambda c: F.struct(
            c.alias("name"), c.alias("expression"), F.lit(None).cast("int").alias("line"))).alias("calls"),
    )


def _route(verb, path, framework, *, name=None, qualified=None, exposes=None) -> Column:
    shown = F.concat(verb, F.lit(" "), path)
    return F.struct(
        verb.alias("verb"), path.alias("path"), (shown if name is None else name).alias("name"),
        (shown if qualified is None else qualified).alias("qualified"), framework.alias("framework"), F.lit("").alias("handler"),
        (F.lit("") if exposes is None else exposes).alias("exposes"), F.lit(0).alias("line"),
    )


def _bases(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))


def _imports(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("target"), F.lit(False).alias("relative")))


# --------------------------------------------------------------------------- JavaScript, TypeScript

# Web patterns and tables.
WEB_CLASS = (
    r"(?:export\s+)?(?:abstract\s+)?\bclass\b\s+([A-Za-z_$][\w$]*)\s*(<[^{]*?>)?\s*((?:extends|implements)[^{]*)?\{"
)
WEB_INTERFACE = r"(?:export\s+)?\binterface\b\s+([A-Za-z_$][\w$]*)\s*(<[^{]*?>)?\s*(extends[^{]*)?\{"
WEB_ENUM = r"(?:export\s+)?\benum\s+([A-Za-z_$][\w$]*)\s*\{([^}]*)\}"
WEB_FUNCTION = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
WEB_ARROW = (
    r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"
)
WEB_IMPORT = r"""import\s+(?:[^'"]*?\sfrom\s+)?['"]([^'"]+)['"]"""
WEB_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
WEB_ROUTE = r"""\b(?:app|router|server|api)\.(get|post|put|patch|delete|all|use)\(\s*['"]([^'"]+)['"]"""
WEB_DECORATOR = r"""@(Get|Post|Put|Patch|Delete)\(\s*['"]?([^'")]*)['"]?\s*\)"""
WEB_MEMBER = (
    r"(?m)^\s*(?:((?:public|private|protected|readonly|static|async|abstract)\s+))*([A-Za-z_$][\w$]*)\s*"
    r"(\([^)]*\))?\s*(?::\s*([^;={\n]+))?[;={]"
)
WEB_NOT_MEMBERS = ("if", "for", "while", "switch", "return", "constructor")
WEB_HINTS = (
    ("axios", "external_api", "axios"), ("node-fetch", "external_api", "fetch"), ("got", "external_api", "got"),
    ("mongoose", "database", "MongoDB"), ("mongodb", "database", "MongoDB"), ("pg", "database", "PostgreSQL"),
    ("mysql2", "database", "MySQL"), ("mysql", "database", "MySQL"), ("sqlite3", "database", "SQLite"),
    ("typeorm", "database", "TypeORM"), ("sequelize", "database", "Sequelize"), ("@prisma/client", "database", "Prisma"),
    ("redis", "database", "Redis"), ("ioredis", "database", "Redis"), ("amqplib", "queue", "RabbitMQ"),
    ("kafkajs", "queue", "Kafka"), ("bull", "queue", "Bull"), ("socket.io", "queue", "Socket.IO"),
)
WEB_STEREOTYPES = tuple((s, s) for s in (
    "controller", "service", "repository", "store", "component", "provider", "guard", "middleware", "model", "client"))


def resolve_relative(folder: Column, module: Column) -> Column:
    """Path of a relative import, ``.`` dropped and ``..`` popping one folder."""
    parts = F.filter(F.split(F.concat_ws("/", folder, module), "/"), lambda p: (p != "") & (p != "."))
    popped = F.aggregate(
        parts, F.expr(NO_STRINGS),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(popped, "/")


def _web_members(body: Column) -> Column:
    rows = F.transform(_all(WEB_MEMBER, 0, body), lambda m: F.struct(
        mt.group(m, WEB_MEMBER, 1).alias("modifier"), mt.group(m, WEB_MEMBER, 2).alias("name"),
        (mt.group(m, WEB_MEMBER, 3) != "").alias("call"), F.trim(mt.group(m, WEB_MEMBER, 4)).alias("type"),
    ))
    real = F.filter(rows, lambda r: ~r["name"].isin(*WEB_NOT_MEMBERS))
    return mt.first_by(real, "name")


def _web_visibility(modifier: Column) -> Column:
    return F.when(modifier.contains("private"), "private").when(modifier.contains("protected"), "protected").otherwise("public")


def _web_split(members: Column) -> tuple[Column, Column]:
    methods = F.transform(F.filter(members, lambda m: m["call"]), lambda m: _member(
        m["name"], _web_visibility(m["modifier"]), m["type"], m["modifier"].contains("static")))
    properties = F.transform(F.filter(members, lambda m: ~m["call"]), lambda m: _property(
        m["name"], m["type"], _web_visibility(m["modifier"])))
    return methods, properties


def web_facts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = _staged(files, ("javascript", "typescript"), keys)
    text = F.col("text")
    modules = F.array_union(_all(WEB_IMPORT, 1), _all(WEB_REQUIRE, 1))
    staged = staged.withColumns({
        "class_rows": F.transform(mt.blocks(text, WEB_CLASS), lambda b: F.struct(b.alias("block"), _web_members(b["body"]).alias("members"))),
        "interface_rows": F.transform(mt.blocks(text, WEB_INTERFACE), lambda b: F.struct(b.alias("block"), _web_members(b["body"]).alias("members"))),
        "modules": modules,
    })

    def class_of(row: Column) -> Column:
        b, members = row["block"], row["members"]
        name = mt.group(b["header"], WEB_CLASS, 1)
        clause = mt.group(b["header"], WEB_CLASS, 3)
        extends = F.regexp_extract(clause, r"extends\s+([^{]*?)(?:implements|$)", 1)
        implements = F.regexp_extract(clause, r"implements\s+([^{]*)$", 1)
        methods, properties = _web_split(members)
        bare = F.transform(properties, lambda p: F.regexp_replace(F.trim(F.element_at(F.split(p["type"], "<"), 1)), r"[\[\]]+$", ""))
        low = first_match(F.lower(name), WEB_STEREOTYPES, default=F.when(b["body"].contains("@Injectable"), "service").otherwise(""))
        return _type(
            name, F.lit("class"), b["line"], stereotype=low,
            bases=F.concat(_bases(mt.type_names(extends), "inherits"), _bases(mt.type_names(implements), "implements")),
            composes=F.filter(bare, mt.starts_upper), calls=mt.calls(b["body"]), methods=methods, properties=properties,
        )

    def interface_of(row: Column) -> Column:
        b, members = row["block"], row["members"]
        clause = F.replace(mt.group(b["header"], WEB_INTERFACE, 3), F.lit("extends"), F.lit(""))
        methods, properties = _web_split(members)
        return _type(mt.group(b["header"], WEB_INTERFACE, 1), F.lit("interface"), b["line"],
                     bases=_bases(mt.type_names(clause), "inherits"), methods=methods, properties=properties)

    def enum_of(h: Column) -> Column:
        members = F.transform(F.split(mt.group(h["match"], WEB_ENUM, 2), ","), lambda m: F.trim(F.element_at(F.split(F.trim(m), "="), 1)))
        return _type(mt.group(h["match"], WEB_ENUM, 1), F.lit("enum"), h["line"],
                     members=F.filter(members, lambda m: m != ""))

    def function_of(pattern: str):
        def build(h: Column) -> Column:
            raw = F.filter(F.split(mt.group(h["match"], pattern, 2), ","), lambda p: F.trim(p) != "")
            params = F.transform(raw, lambda p: F.struct(
                F.element_at(F.split(F.trim(p), ":"), 1).alias("name"), F.trim(F.regexp_extract(p, r"(?s):(.*)$", 1)).alias("type")))
            return _function(mt.group(h["match"], pattern, 1), h["line"], params=params,
                             visibility=F.when(h["match"].contains("export"), "public").otherwise("internal"))
        return build

    functions = F.concat(
        F.transform(mt.matches(text, WEB_FUNCTION), function_of(WEB_FUNCTION)),
        F.transform(mt.matches(text, WEB_ARROW), function_of(WEB_ARROW)),
    )
    express = F.filter(
        F.transform(_all(WEB_ROUTE, 0), lambda r: _route(
            F.upper(mt.group(r, WEB_ROUTE, 1)), mt.group(r, WEB_ROUTE, 2), F.lit("express-like"))),
        lambda r: r["verb"] != "USE",
    )
    nest = F.transform(_all(WEB_DECORATOR, 0), lambda r: _route(
        F.upper(mt.group(r, WEB_DECORATOR, 1)),
        F.coalesce(F.nullif(mt.group(r, WEB_DECORATOR, 2), F.lit("")), F.lit("/")), F.lit("nestjs")))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    imports = F.transform("modules", lambda m: F.when(
        m.startswith("."), F.struct(resolve_relative(folder, m).alias("target"), F.lit(True).alias("relative"))
    ).otherwise(F.struct(m.alias("target"), F.lit(False).alias("relative"))))
    outside = F.filter("modules", lambda m: ~m.startswith("."))
    exact = F.transform(outside, lambda m: F.when(
        F.array_contains(F.array(*[F.lit(t) for t, _, _ in WEB_HINTS]), m), m).otherwise(F.element_at(F.split(m, "/"), 1)))
    return fact_rows(
        staged, keys, imports=imports, hints=mt.hints(exact, WEB_HINTS, "equals"),
        types=F.concat(F.transform("class_rows", class_of), F.transform("interface_rows", interface_of),
                       F.transform(mt.matches(text, WEB_ENUM), enum_of)),
        functions=mt.first_by(functions, "name"), routes=F.concat(express, nest),
    )


# --------------------------------------------------------------------------- Java, C#

# Java and C# patterns and tables.
JVM_TYPE = (
    r"((?:\b(?:public|private|protected|internal|static|abstract|final|sealed|partial)\b\s+)*)"
    r"\b(class|interface|enum|record|struct)\b\s+([A-Za-z_]\w*)\s*(<[^{]*?>)?\s*((?::|extends|implements)[^{]*)?\{"
)
JVM_IMPORT = r"(?m)^\s*(?:import|using)\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;"
JVM_NAMESPACE = r"(?m)^\s*(?:package|namespace)\s+([A-Za-z_][\w.]*)"
JVM_ANNOTATION = r"@([A-Za-z_]\w*)(?:\(([^)]*)\))?"
JVM_ATTRIBUTE = r"\[([A-Za-z_]\w*)(?:\(([^\]]*)\))?\]"
JVM_ROUTE = r'(?:@|\[)([A-Za-z]+)(?:\(\s*(?:"|value\s*=\s*")([^"]*)")?'
JVM_TABLE = r'@Table\s*\(\s*name\s*=\s*"([^"]+)"'
JVM_KINDS = {"interface": "interface", "enum": "enum", "struct": "struct"}
JVM_ROUTES = (
    ("getmapping", "GET"), ("postmapping", "POST"), ("putmapping", "PUT"), ("deletemapping", "DELETE"),
    ("patchmapping", "PATCH"), ("requestmapping", "ANY"), ("httpget", "GET"), ("httppost", "POST"), ("httpput", "PUT"),
    ("httpdelete", "DELETE"), ("httppatch", "PATCH"), ("route", "ANY"), ("path", "ANY"),
)
JVM_STEREOTYPES = (
    ("restcontroller", "controller"), ("controller", "controller"), ("apicontroller", "controller"), ("service", "service"),
    ("repository", "repository"), ("component", "component"), ("entity", "entity"), ("configuration", "configuration"),
    ("table", "entity"),
)
JVM_HINTS = (
    ("org.springframework.jdbc", "database", "Spring JDBC"), ("javax.persistence", "database", "JPA"),
    ("jakarta.persistence", "database", "JPA"), ("org.hibernate", "database", "Hibernate"),
    ("microsoft.entityframeworkcore", "database", "EF Core"), ("system.data", "database", "ADO.NET"),
    ("org.apache.kafka", "queue", "Kafka"), ("com.rabbitmq", "queue", "RabbitMQ"), ("masstransit", "queue", "MassTransit"),
    ("azure.messaging", "queue", "Azure Messaging"), ("system.net.http", "external_api", "HttpClient"),
    ("okhttp3", "external_api", "OkHttp"), ("org.springframework.web.client", "external_api", "RestTemplate"),
    ("redis", "database", "Redis"), ("mongodb", "database", "MongoDB"),
)


def jvm_facts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = _staged(files, ("java", "csharp"), keys)
    text = F.col("text")
    staged = staged.withColumn("namespace", F.regexp_extract("text", JVM_NAMESPACE, 1))
    default = F.col("language") == "java"

    def with_parts(b: Column) -> Column:
        preamble = F.element_at(F.split(b["before"], "[;{}]"), -1)  # back to the end of the declaration before
        notes = F.concat(_all(JVM_ANNOTATION, 1, preamble), _all(JVM_ATTRIBUTE, 1, preamble))
        known = F.filter(
            F.transform(notes, lambda n: first_match(F.lower(n), JVM_STEREOTYPES, contains=False)), lambda s: s != "")
        package, private = (mt.methods(b["body"], d) for d in ("package", "private"))
        return F.struct(
            b["header"].alias("header"), b["line"].alias("line"), b["body"].alias("body"),
            mt.group(b["header"], JVM_TYPE, 3).alias("name"),
            F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit("")).alias("stereotype"),
            F.when(default, package).otherwise(private).alias("methods"), mt.fields(b["body"]).alias("properties"),
        )

    staged = staged.withColumn("rows", F.transform(mt.blocks(text, JVM_TYPE), with_parts))
    full = lambda name: F.when(F.col("namespace") != "", F.concat("namespace", F.lit("."), name)).otherwise(name)

    def type_of(r: Column) -> Column:
        word = mt.group(r["header"], JVM_TYPE, 2)
        abstract = mt.group(r["header"], JVM_TYPE, 1).contains("abstract")
        kind = F.when(word.isin(*JVM_KINDS), word).when(abstract, "abstract_class").otherwise("class")
        clause = F.regexp_replace(mt.group(r["header"], JVM_TYPE, 5), r"^\s*(?::|extends|implements)\s*", "")
        names = mt.type_names(F.replace(F.replace(clause, F.lit("implements"), F.lit(",")), F.lit("extends"), F.lit(",")))
        bases = F.transform(names, lambda n: F.struct(
            n.alias("name"), F.when(n.rlike(r"^I\p{Lu}"), "implements").otherwise("inherits").alias("kind")))
        parts = F.transform(r["properties"], lambda p: F.regexp_replace(
            F.replace(F.element_at(F.split(p["type"], "<"), -1), F.lit(">"), F.lit("")), r"[\[\]*&]", ""))
        members = F.when(kind == "enum", F.regexp_extract_all(r["body"], F.lit(r"(?m)^\s*([A-Z][A-Z0-9_]*)\s*[,;=]"), F.lit(1)))
        return _type(
            r["name"], kind, r["line"], qualified=full(r["name"]), stereotype=r["stereotype"], bases=bases,
            composes=F.filter(parts, mt.starts_upper), calls=mt.calls(r["body"]), methods=r["methods"],
            properties=r["properties"], members=F.coalesce(members, _strings()), is_orm=r["stereotype"] == "entity",
        )

    def routes_of(r: Column) -> Column:
        found = F.transform(F.regexp_extract_all(r["body"], F.lit(JVM_ROUTE), F.lit(0)), lambda a: F.struct(
            first_match(F.lower(mt.group(a, JVM_ROUTE, 1)), JVM_ROUTES, contains=False).alias("verb"),
            F.coalesce(F.nullif(mt.group(a, JVM_ROUTE, 2), F.lit("")), F.lit("/")).alias("path")))
        owner = F.concat(F.lit("type:"), F.col("language"), F.lit(":"), full(r["name"]))
        return F.transform(F.filter(found, lambda x: x["verb"] != ""), lambda x: _route(
            x["verb"], x["path"], F.col("language"), exposes=owner))

    def table_of(r: Column) -> Column:
        named = F.regexp_extract(F.concat(r["header"], r["body"]), JVM_TABLE, 1)
        columns = F.transform(r["properties"], lambda p: F.struct(
            p["name"].alias("name"), p["type"].alias("type"), F.lit(False).alias("primary_key"), F.lit(True).alias("nullable")))
        return F.struct(
            full(r["name"]).alias("owner"), F.when(named != "", named).otherwise(F.lower(r["name"])).alias("table"),
            columns.alias("columns"), F.expr("cast(array() as array<struct<column:string,references:string>>)").alias("fks"),
            _strings().alias("relations"),
        )

    modules = _all(JVM_IMPORT, 1)
    return fact_rows(
        staged, keys, namespace=F.col("namespace"), imports=_imports(modules), hints=mt.hints(modules, JVM_HINTS),
        types=F.transform("rows", type_of), routes=F.flatten(F.transform("rows", routes_of)),
        orm=F.transform(F.filter("rows", lambda r: r["stereotype"] == "entity"), table_of),
    )


# --------------------------------------------------------------------------- Go

# Go patterns.
GO_IMPORT_BLOCK = r"import\s*\(([^)]*)\)"
GO_IMPORT = r'(?m)^\s*import\s+(?:[A-Za-z_.]+\s+)?"([^"]+)"'
GO_STRUCT = r"type\s+([A-Za-z_]\w*)\s+struct\s*\{"
GO_INTERFACE = r"type\s+([A-Za-z_]\w*)\s+interface\s*\{"
GO_METHOD = r"func\s*\(\s*\w+\s+\*?([A-Za-z_]\w*)\s*\)\s*([A-Za-z_]\w*)\s*\(([^)]*)\)\s*([^{\n]*)\{"
GO_FUNC = r"(?m)^func\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*([^{\n]*)\{"
GO_FIELD = r"(?m)^\s*([A-Z_]\w*)\s+([\w*\[\].{}]+)"
GO_ROUTE = r'\.(?:Handle|HandleFunc|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*"([^"]+)"'
# Go and Rust integrations and name stereotypes.
GO_RUST_HINTS = (
    ("database/sql", "database", "database/sql"), ("gorm.io", "database", "GORM"), ("go-redis", "database", "Redis"),
    ("mongo-driver", "database", "MongoDB"), ("sqlx", "database", "SQLx"), ("diesel", "database", "Diesel"),
    ("sea_orm", "database", "SeaORM"), ("redis", "database", "Redis"), ("net/http", "external_api", "net/http"),
    ("reqwest", "external_api", "reqwest"), ("hyper", "external_api", "hyper"), ("grpc", "external_api", "gRPC"),
    ("tonic", "external_api", "tonic gRPC"), ("sarama", "queue", "Kafka"), ("rdkafka", "queue", "Kafka"),
    ("amqp", "queue", "AMQP"), ("nats", "queue", "NATS"), ("lapin", "queue", "RabbitMQ"),
)
GO_RUST_STEREOTYPES = (
    ("service", "service"), ("repository", "repository"), ("handler", "handler"), ("client", "client"),
    ("server", "server"), ("config", "configuration"), ("store", "store"),
)


def _in_module(name: Column) -> Column:
    return F.concat("module", F.lit("."), name)


def go_facts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = _staged(files, ("go",), keys)
    text = F.col("text")
    grouped = F.flatten(F.transform(_all(GO_IMPORT_BLOCK, 1), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    staged = staged.withColumn("modules", F.array_sort(F.array_union(grouped, _all(GO_IMPORT, 1))))

    def struct_of(b: Column) -> Column:
        name = mt.group(b["header"], GO_STRUCT, 1)
        fields = F.transform(F.regexp_extract_all(b["body"], F.lit(GO_FIELD), F.lit(0)), lambda m: _property(
            mt.group(m, GO_FIELD, 1), mt.group(m, GO_FIELD, 2), F.lit("public")))
        parts = F.transform(fields, lambda p: F.element_at(F.split(F.regexp_replace(p["type"], r"^[*\[\]]+", ""), r"\."), -1))
        return _type(name, F.lit("struct"), b["line"], stereotype=first_match(F.lower(name), GO_RUST_STEREOTYPES),
                     composes=F.filter(parts, mt.starts_upper), properties=fields)

    def interface_of(b: Column) -> Column:
        names = F.regexp_extract_all(b["body"], F.lit(r"(?m)^\s*([A-Z]\w*)\s*\("), F.lit(1))
        return _type(mt.group(b["header"], GO_INTERFACE, 1), F.lit("interface"), b["line"],
                     methods=F.transform(names, lambda n: _member(n, F.lit("public"))))

    visible = lambda n: F.when(mt.starts_upper(n), "public").otherwise("private")

    def method_of(b: Column) -> Column:
        owner, name = mt.group(b["header"], GO_METHOD, 1), mt.group(b["header"], GO_METHOD, 2)
        return _function(
            name, b["line"], qualified=F.concat("module", F.lit("."), owner, F.lit("."), name), owner=_in_module(owner),
            params=F.expr("cast(array() as array<struct<name:string,type:string>>)"),
            returns=F.trim(mt.group(b["header"], GO_METHOD, 4)), visibility=visible(name), calls=mt.calls(b["body"]))

    def late_of(b: Column) -> Column:
        name = mt.group(b["header"], GO_METHOD, 2)
        return F.struct(
            _in_module(mt.group(b["header"], GO_METHOD, 1)).alias("owner"),
            _member(name, visible(name), F.trim(mt.group(b["header"], GO_METHOD, 4))).alias("method"))

    free = F.transform(mt.matches(text, GO_FUNC), lambda h: _function(
        mt.group(h["match"], GO_FUNC, 1), h["line"], returns=F.trim(mt.group(h["match"], GO_FUNC, 3))))
    routes = F.transform(_all(GO_ROUTE, 1), lambda p: _route(
        F.lit("ANY"), p, F.lit("go-http"), name=F.concat(F.lit("HTTP "), p), qualified=p))
    methods = mt.blocks(text, GO_METHOD)
    return fact_rows(
        staged, keys, imports=_imports(F.col("modules")), hints=mt.hints(F.col("modules"), GO_RUST_HINTS),
        types=F.concat(F.transform(mt.blocks(text, GO_STRUCT), struct_of), F.transform(mt.blocks(text, GO_INTERFACE), interface_of)),
        functions=F.concat(F.transform(methods, method_of), free), late_methods=F.transform(methods, late_of), routes=routes,
    )


# --------------------------------------------------------------------------- Rust

# Rust patterns and wrapper types.
RS_USE = r"(?m)^\s*(?:pub\s+)?use\s+([A-Za-z_][\w:]*)"
RS_MOD = r"(?m)^\s*(?:pub\s+)?mod\s+([A-Za-z_]\w*)\s*;"
RS_STRUCT = r"(?:pub\s+)?struct\s+([A-Za-z_]\w*)(?:<[^>{]*>)?\s*\{"
RS_ENUM = r"(?:pub\s+)?enum\s+([A-Za-z_]\w*)(?:<[^>{]*>)?\s*\{"
RS_TRAIT = r"(?:pub\s+)?trait\s+([A-Za-z_]\w*)(?:<[^>{]*>)?[^{]*\{"
RS_IMPL = r"impl(?:<[^>]*>)?\s+(?:([A-Za-z_][\w:]*)(?:<[^>]*>)?\s+for\s+)?([A-Za-z_][\w:]*)(?:<[^>{]*>)?\s*\{"
RS_FN = r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"
RS_FIELD = r"(?m)^\s*(pub(?:\([^)]*\))?\s+)?([a-z_]\w*)\s*:\s*([^,\n]+)"
RS_WRAPPERS = ("String", "Vec", "Option", "Result", "Box", "Arc", "Rc")


def rust_facts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = _staged(files, ("rust",), keys)
    text = F.col("text")
    roots = F.transform(_all(RS_USE, 1), lambda p: F.element_at(F.split(p, "::"), 1))
    staged = staged.withColumn("modules", F.array_sort(F.array_union(roots, _all(RS_MOD, 1))))
    last = lambda c: F.element_at(F.split(c, "::"), -1)

    def struct_of(b: Column) -> Column:
        name = mt.group(b["header"], RS_STRUCT, 1)
        fields = F.transform(F.regexp_extract_all(b["body"], F.lit(RS_FIELD), F.lit(0)), lambda m: _property(
            mt.group(m, RS_FIELD, 2), F.regexp_replace(F.trim(mt.group(m, RS_FIELD, 3)), ",+$", ""),
            F.when(mt.group(m, RS_FIELD, 1) != "", "public").otherwise("private")))
        tokens = F.flatten(F.transform(fields, lambda p: F.filter(
            F.split(F.regexp_replace(p["type"], r"[<>&\s]", " "), " +"), lambda t: t != "")))
        parts = F.filter(F.transform(tokens, last), lambda t: mt.starts_upper(t) & ~t.isin(*RS_WRAPPERS))
        return _type(name, F.lit("struct"), b["line"], stereotype=first_match(F.lower(name), GO_RUST_STEREOTYPES),
                     composes=parts, properties=fields)

    def enum_of(b: Column) -> Column:
        members = F.transform(F.filter(F.split(b["body"], ","), lambda m: mt.starts_upper(F.regexp_replace(m, r"^\s+", ""))),
                              lambda m: F.element_at(F.split(F.regexp_replace(m, r"^\s+|\s+$", ""), r"\("), 1))
        return _type(mt.group(b["header"], RS_ENUM, 1), F.lit("enum"), b["line"], members=members)

    names = lambda b: F.regexp_extract_all(b["body"], F.lit(RS_FN), F.lit(1))

    def trait_of(b: Column) -> Column:
        return _type(mt.group(b["header"], RS_TRAIT, 1), F.lit("interface"), b["line"],
                     methods=F.transform(names(b), lambda n: _member(n, F.lit("public"))))

    impls = F.transform(mt.blocks(text, RS_IMPL), lambda b: F.struct(
        _in_module(last(mt.group(b["header"], RS_IMPL, 2))).alias("owner"),
        last(mt.group(b["header"], RS_IMPL, 1)).alias("base"), names(b).alias("names"), mt.calls(b["body"]).alias("calls")))
    staged = staged.withColumn("impls", impls)
    late_methods = F.flatten(F.transform("impls", lambda i: F.transform(i["names"], lambda n: F.struct(
        i["owner"].alias("owner"), _member(n, F.lit("public")).alias("method")))))
    late_bases = F.transform(F.filter("impls", lambda i: i["base"] != ""), lambda i: F.struct(i["owner"].alias("owner"), i["base"].alias("base")))
    late_calls = F.flatten(F.transform("impls", lambda i: F.transform(i["calls"], lambda c: F.struct(
        i["owner"].alias("owner"), c.alias("callee")))))
    return fact_rows(
        staged, keys, imports=_imports(F.col("modules")), hints=mt.hints(F.col("modules"), GO_RUST_HINTS),
        types=F.concat(F.transform(mt.blocks(text, RS_STRUCT), struct_of), F.transform(mt.blocks(text, RS_ENUM), enum_of),
                       F.transform(mt.blocks(text, RS_TRAIT), trait_of)),
        late_methods=late_methods, late_bases=late_bases, late_calls=late_calls,
    )


# --------------------------------------------------------------------------- C, C++

# C and C++ patterns and tables.
C_TYPE = r"\b(class|struct)\b\s+(?:[A-Z_]+_API\s+)?([A-Za-z_]\w*)\s*(:[^{;]*)?\{"
C_ENUM = r"\benum\s+(?:class\s+)?([A-Za-z_]\w*)[^{]*\{([^}]*)\}"
C_INCLUDE = r'(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]'
C_NAMESPACE = r"(?m)^\s*namespace\s+([A-Za-z_]\w*)"
C_FUNC = (
    r"(?m)^(?!\s*(?:if|for|while|switch|return|else)\b)\s*([A-Za-z_][\w:<>,*&\s]*?)\s+([A-Za-z_]\w*)\s*"
    r"\(([^;{)]*)\)\s*(?:const\s*)?\{"
)
C_HINTS = (
    ("sqlite3", "database", "SQLite"), ("mysql", "database", "MySQL"), ("libpq-fe", "database", "PostgreSQL"),
    ("hiredis", "database", "Redis"), ("curl/curl", "external_api", "libcurl"), ("cpprest", "external_api", "cpprestsdk"),
    ("zmq", "queue", "ZeroMQ"), ("rdkafka", "queue", "librdkafka"), ("mqtt", "queue", "MQTT"), ("grpc", "external_api", "gRPC"),
    ("boost/asio", "external_api", "Boost.Asio"),
)
C_STANDARD = (
    "stdio.h", "stdlib.h", "string.h", "math.h", "vector", "string", "memory", "map", "set", "algorithm", "iostream",
    "cstdint", "cstring", "thread", "mutex", "chrono", "functional", "optional", "array", "utility",
)


def c_facts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    staged = _staged(files, ("c", "cpp"), keys)
    text = F.col("text")
    staged = staged.withColumns({
        "namespace": F.regexp_extract("text", C_NAMESPACE, 1),
        "rows": mt.blocks(text, C_TYPE),
        "headers": F.filter(_all(C_INCLUDE, 1), lambda h: ~F.lower(h).isin(*C_STANDARD)),
    })
    full = lambda name: F.when(F.col("namespace") != "", F.concat("namespace", F.lit("::"), name)).otherwise(name)

    def type_of(b: Column) -> Column:
        word, name = mt.group(b["header"], C_TYPE, 1), mt.group(b["header"], C_TYPE, 2)
        is_class = word == "class"
        methods = F.when(is_class, mt.methods(b["body"], "private")).otherwise(mt.methods(b["body"], "public"))
        fields = F.when(is_class, mt.fields(b["body"], "private")).otherwise(mt.fields(b["body"], "public"))
        abstract = b["body"].rlike(r"virtual[^;{]*=\s*0\s*;")
        parts = F.transform(fields, lambda p: F.element_at(F.split(F.regexp_replace(
            F.replace(F.element_at(F.split(p["type"], "<"), -1), F.lit(">"), F.lit("")), r"[*&]", ""), "::"), -1))
        clause = F.regexp_replace(mt.group(b["header"], C_TYPE, 3), "^:+", "")
        return _type(
            name, F.when(abstract, "abstract_class").when(is_class, "class").otherwise("struct"), b["line"], qualified=full(name),
            bases=_bases(mt.type_names(clause), "inherits"), composes=F.filter(parts, mt.starts_upper),
            calls=mt.calls(b["body"]), methods=methods, properties=fields)

    def enum_of(h: Column) -> Column:
        members = F.transform(F.split(mt.group(h["match"], C_ENUM, 2), ","), lambda m: F.regexp_replace(
            F.element_at(F.split(m, "="), 1), r"^\s+|\s+$", ""))
        return _type(mt.group(h["match"], C_ENUM, 1), F.lit("enum"), h["line"],
                     members=F.filter(members, lambda m: m != ""))

    outside = F.filter(mt.matches(text, C_FUNC), lambda f: ~F.exists("rows", lambda b: f["start"].between(
        b["start"], b["start"] + F.char_length(b["header"]) + F.char_length(b["body"]))))
    named = F.filter(outside, lambda f: ~mt.group(f["match"], C_FUNC, 2).isin("if", "for", "while", "switch", "catch", "return"))
    functions = F.transform(named, lambda f: _function(
        mt.group(f["match"], C_FUNC, 2), f["line"],
        returns=F.element_at(F.split(F.trim(mt.group(f["match"], C_FUNC, 1)), r"\s+"), -1)))
    return fact_rows(
        staged, keys, namespace=F.col("namespace"), imports=_imports(F.col("headers")), hints=mt.hints(F.col("headers"), C_HINTS),
        types=F.concat(F.transform("rows", type_of), F.transform(mt.matches(text, C_ENUM), enum_of)), functions=functions,
    )


for _name, _fn in (("jvm", jvm_facts), ("web", web_facts), ("c", c_facts), ("go", go_facts), ("rust", rust_facts)):
    register_extractor(_name, _fn)

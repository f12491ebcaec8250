"""A source-code corpus that Spark writes from the ``part`` table.

One part is one file; its key decides language, folder and the file it depends
on, so the facts every extractor must find follow from the key by arithmetic.
The project ``mono`` holds a third of all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.queries.registry import table
from archspark.session import staged
from archspark.sources.tree import classify_files

# Columns that both engines compute in the same way.
BASE = """
SELECT id, project_id, lang, sub, id + 24 AS nxt, id + 192 AS peer,
       'svc' || CAST(CAST(floor(id / 24) AS BIGINT) % 4 AS STRING) AS svc,
       'svc' || CAST(CAST(floor((id + 24) / 24) AS BIGINT) % 4 AS STRING) AS nsvc,
       CASE id % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'core' WHEN 2 THEN 'data' WHEN 3 THEN 'web' ELSE 'zone' END AS dir,
       CASE (id + 24) % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'core' WHEN 2 THEN 'data' WHEN 3 THEN 'web' ELSE 'zone' END AS ndir,
       replace(p_name, ' ', '_') AS noun, CAST(floor(p_retailprice) AS BIGINT) + 1000 AS price
FROM (
  SELECT p_partkey AS id, p_name, p_retailprice,
         CASE WHEN p_partkey % 3 = 0 THEN 'mono' ELSE 'p' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING) END AS project_id,
         CASE p_partkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'java'
              WHEN 4 THEN 'go' WHEN 5 THEN 'rust' WHEN 7 THEN 'cpp' ELSE
              CASE CAST(floor(p_partkey / 8) AS BIGINT) % 8 WHEN 0 THEN 'docker' WHEN 1 THEN 'compose' WHEN 2 THEN 'npm'
                   WHEN 3 THEN 'pip' WHEN 4 THEN 'k8s' WHEN 5 THEN 'markdown' ELSE 'sql' END
         END AS lang,
         CAST(floor(p_partkey / 8) AS BIGINT) % 8 AS sub
  FROM {part}
) AS numbered
"""

PATHS = {
    "python": "{svc}/{dir}/mod{id}.py",
    "typescript": "{svc}/{dir}/mod{id}.ts",
    "java": "{svc}/{dir}/Gadget{id}.java",
    "go": "{svc}/{dir}/mod{id}.go",
    "rust": "{svc}/{dir}/mod{id}.rs",
    "cpp": "{svc}/{dir}/mod{id}.hpp",
    "sql": "{svc}/schema/{id}.sql",
    "docker": "{svc}/m{id}/Dockerfile",
    "compose": "{svc}/m{id}/docker-compose.yml",
    "npm": "{svc}/m{id}/package.json",
    "pip": "{svc}/m{id}/requirements.txt",
    "k8s": "{svc}/m{id}/deploy.yaml",
    "markdown": "docs/m{id}.md",
}
TEST_PATH = "{svc}/tests/test_mod{id}.py"  # python files with id % 16 = 8

TEXTS = {
    "python": '''"""Module {id} about {noun}."""
import os
import requests
from {nsvc}.{ndir}.mod{nxt} import Widget{nxt}

# TODO: tidy {noun}
class Widget{id}(Widget{nxt}):
    """Holds {noun}."""
    peer: Widget{nxt} = None

    def run(self, a, b):
        if a and b:
            return fetch{nxt}(a, b)
        return self.helper{id}(a)

    def helper{id}(self, x):
        for i in range(x):
            os.system("echo " + str(i))
        return {price}

@app.get("/items/{id}")
def fetch{id}(a, b):
    return requests.get("http://api{sub}.internal.net/v1/" + str({price}), verify=False)

class Status{id}(Enum):
    NEW = 1
    DONE = 2
''',
    "typescript": '''import {{ Panel{nxt} }} from "../../{nsvc}/{ndir}/mod{nxt}";
import axios from "axios";
export interface IPanel{id} {{ title: string; }}
export class Panel{id} extends Panel{nxt} implements IPanel{id} {{
  private peer: Panel{nxt};
  render(): string {{
    console.log(this.peer);
    return build{id}(this.peer);
  }}
}}
/* FIXME later: {noun} */
export function build{id}(p: Panel{nxt}) {{ return axios.get("http://x{sub}.example.org/" + {price}); }}
app.get("/panels/{id}", build{id});
''',
    "java": '''package com.{svc}.{dir};
import com.{nsvc}.{ndir}.Gadget{nxt};
import org.apache.kafka.clients.Producer;

@Service
public class Gadget{id} extends Gadget{nxt} implements IRunner {{
    private Gadget{nxt} peer;
    private static final int LIMIT = {price};
    @GetMapping("/gadgets/{id}")
    public String run(int a, String b) {{
        if (a > 1) {{ return peer.load(a); }}
        return compute{id}(b);
    }}
    protected String compute{id}(String s) {{ return s; }}
}}
''',
    "go": '''package {dir}
import (
  "fmt"
  "net/http"
)
type Node{id} struct {{
  Next Node{nxt}
  Size int
}}
type Walker{id} interface {{
  Walk()
}}
func (n *Node{id}) Walk() {{
  visit{nxt}(n)
}}
func visit{id}(n int) int {{
  http.HandleFunc("/nodes/{id}", nil)
  return {price}
}}
''',
    "rust": '''use crate::{ndir}::mod{nxt};
mod helper{id};
pub struct Cell{id} {{
    pub next: Option<Cell{nxt}>,
    size: u32,
}}
pub enum Mode{id} {{
    Active,
    Closed,
}}
pub trait Walk{id} {{
    fn walk(&self);
}}
impl Walk{id} for Cell{id} {{
    fn walk(&self) {{ relay{nxt}(self); }}
}}
''',
    "cpp": '''#include <vector>
#include "{nsvc}/{ndir}/mod{nxt}.hpp"
namespace {dir} {{
class Shape{id} : public Shape{nxt} {{
public:
  virtual void draw() = 0;
  static int count;
}};
}}
int area{id}(int w, int h) {{
  return measure{nxt}(w) * h;
}}
''',
    "sql": '''CREATE TABLE t{id} (
  id INTEGER PRIMARY KEY,
  name TEXT NOT NULL,
  parent_id INTEGER REFERENCES t{peer}(id),
  amount NUMERIC(10,2) UNIQUE
);
CREATE INDEX ix_t{id} ON t{id} (name);
CREATE VIEW v{id} AS SELECT * FROM t{id};
''',
    "docker": '''FROM python:3.12-slim
EXPOSE 8080 {price}
USER root
CMD ["python", "-m", "app{id}"]
''',
    "compose": '''services:
  api{id}:
    image: {noun}/api
    ports: ["80:80"]
    depends_on: [db{id}]
    environment:
      TOKEN: x
      MODE: y
  db{id}:
    image: postgres:16
''',
    "npm": '''{{"name": "pkg{id}", "scripts": {{"build": "tsc", "test": "jest"}},
 "dependencies": {{"react": "^18.0.0", "lib{id}": "1.0.{sub}"}}, "devDependencies": {{"jest": "29.0.0"}}}}
''',
    "pip": '''# pinned
pandas>=2.0
lib-{id}==1.{sub}
-r other.txt
''',
    "k8s": '''apiVersion: apps/v1
kind: Deployment
metadata:
  name: work{id}
spec:
  replicas: 3
  template:
    spec:
      containers:
        - image: redis:7
---
apiVersion: v1
kind: Service
metadata:
  name: front{id}
spec:
  selector:
    app: work{id}
  ports:
    - port: 80
''',
    "markdown": '''# Module {id}

Notes about {noun} and {price} more words.
''',
}


IS_TEST = "(lang = 'python' AND id % 16 = 8)"
FIELDS = ("id", "sub", "nxt", "peer", "svc", "nsvc", "dir", "ndir", "noun", "price")


def _templates() -> list[tuple[str, str, str]]:
    return [(k, PATHS[k], TEXTS[k].replace("{{", "\x01").replace("}}", "\x02")) for k in PATHS]


def raw_files(spark: SparkSession, sf: str) -> DataFrame:
    """project_id, run_id, path, text as a source tree scan would give them."""
    base = spark.sql(BASE, part=table(spark, sf, "part"))
    # one key becomes a whole text: spread the keys before they grow
    base = base.repartition(max(spark.sparkContext.defaultParallelism, 1), "id")
    templates = spark.createDataFrame(_templates(), "lang string, path string, text string")
    rows = base.join(F.broadcast(templates), "lang")  # a fixed table of 13 rows
    path = F.when(F.expr(IS_TEST), F.lit(TEST_PATH)).otherwise(F.col("path"))
    text = F.col("text")
    for name in FIELDS:
        value = F.col(name).cast("string")
        path, text = (F.replace(c, F.lit("{" + name + "}"), value) for c in (path, text))
    text = F.translate(text, "\x01\x02", "{}")
    return rows.select("project_id", F.lit("r1").alias("run_id"), path.alias("path"), text.alias("text"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus files with language, infra kind and module, written and read back.

    Else the planner puts the making of a text into every expression that names the text, and the longest of them into join conditions.
    """
    return staged(classify_files(raw_files(spark, sf)), "corpus-files")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duck_cte() -> str:
    """``corpus``: the same files for the other engine; ``module`` is the folder."""
    values = ", ".join(f"({_literal(k)}, {_literal(p)}, {_literal(t)})" for k, p, t in _templates())
    path, text = f"CASE WHEN {IS_TEST} THEN {_literal(TEST_PATH)} ELSE t_path END", "t_text"
    for name in FIELDS:
        path, text = (f"replace({c}, '{{{name}}}', CAST({name} AS VARCHAR))" for c in (path, text))
    parts = "string_split(path, '/')"
    return f"""templates(lang, t_path, t_text) AS (VALUES {values}),
named AS (
  SELECT base.*, 'r1' AS run_id, {path} AS path, translate({text}, chr(1) || chr(2), '{{}}') AS text
  FROM ({BASE.replace("{part}", "part")}) AS base JOIN templates USING (lang)
),
corpus AS (
  SELECT *, CASE WHEN len({parts}) > 1 THEN array_to_string(list_slice({parts}, 1, least(3, len({parts}) - 1)), '/')
            ELSE '(root)' END AS module
  FROM named
)"""

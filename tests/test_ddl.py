"""Schema facts where brackets nest and quotes hold what looks like syntax."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from archspark.operators.extract import sql
from archspark.schema import KEYS

SCRIPT = """
-- CREATE TABLE not_this (a INT);
/* CREATE TABLE nor_this (a INT); */
CREATE TABLE IF NOT EXISTS "shop"."orders" (
  id BIGINT PRIMARY KEY, -- the key, of course
  "first name" VARCHAR( 20 ) NOT NULL DEFAULT 'a, b); -- no comment',
  amount NUMERIC(10, 2) CHECK (amount > 0 AND (amount IS NOT NULL OR f((a),(b)) = 'UNIQUE')),
  state TEXT DEFAULT 'it''s (open' UNIQUE,
  `user_id` INT REFERENCES shop.users(id),
  kind,
  CONSTRAINT fk_item FOREIGN KEY (item_id) REFERENCES "items" ("id") ON DELETE CASCADE,
  PRIMARY KEY (id, kind),
  CHECK ((id > 0), 'x')
) ENGINE=InnoDB;
CREATE TABLE users (id INT NOT NULL)
;
CREATE UNIQUE INDEX ux ON shop.users (lower(name), "id");
ALTER TABLE users ADD CONSTRAINT c1 FOREIGN KEY (boss_id) REFERENCES users (id);
CREATE OR REPLACE VIEW v.open_orders AS SELECT 1;
CREATE TABLE broken (a INT, b TEXT
"""


def test_nested_brackets_and_quotes(make_files):
    x = sql.extract_ddl(make_files({"db/migrations/001_init.sql": SCRIPT}), KEYS)
    columns = [(r.table, r.name, r.type, r.primary_key, r.nullable, r.unique) for r in x.columns.orderBy("table", "pos").collect()]
    assert columns == [
        ("orders", "id", "BIGINT", True, True, False),
        ("orders", "first name", "VARCHAR(20)", False, False, False),
        ("orders", "amount", "NUMERIC(10,2)", False, True, False),
        ("orders", "state", "TEXT", False, True, True),
        ("orders", "user_id", "INT", False, True, False),
        ("orders", "kind", "TEXT", False, True, False),
        ("users", "id", "INT", False, False, False),
    ]
    fks = sorted((r.table, r.column, r.references_table, r.references_column) for r in x.fks.collect())
    assert fks == [("orders", "item_id", "items", "id"), ("orders", "user_id", "users", "id"), ("users", "boss_id", "users", "id")]
    assert sorted((r["table"], r["index"], r["column"], r["unique"]) for r in x.indexes.collect()) == [("users", "ux", "id", True), ("users", "ux", "lower(name)", True)]
    nodes = {(r.id, r.line) for r in x.nodes.filter(F.col("kind").isin("table", "data_store")).collect()}
    assert {i for i, _ in nodes} == {"table:orders", "table:users", "view:open_orders"}
    assert x.edges.filter("kind = 'writes'").count() == 1


def test_long_scripts_take_linear_time(make_files):
    part = "CREATE TABLE t{i} (a INT CHECK (f((a),(b)) > 0), b TEXT DEFAULT 'x, y', c INT REFERENCES t{i}(a));\n"
    start = time.time()
    x = sql.extract_ddl(make_files({"a.sql": "".join(part.format(i=i) for i in range(3000))}), KEYS)
    assert x.columns.count() == 9000 and time.time() - start < 40

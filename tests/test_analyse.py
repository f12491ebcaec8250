from __future__ import annotations

from archspark.plans.analyse import analyse, run_stats

SAMPLE = {
    "services.py": '''"""Orders."""
from abc import ABC, abstractmethod
from dataclasses import dataclass
from enum import Enum


class OrderStatus(Enum):
    NEW = "new"
    PAID = "paid"
    CLOSED = "closed"


class Repository(ABC):
    @abstractmethod
    def load(self, key):
        ...


class OrderRepository(Repository):
    def load(self, key):
        return key


@dataclass
class Order:
    status: OrderStatus


class OrderService:
    def __init__(self, repository: OrderRepository):
        self.repository = repository

    def find(self, key):
        return self.repository.load(key)
''',
    "api.py": '''from services import OrderService


@app.get("/orders/{order_id}")
def read_order(order_id):
    return OrderService(None).find(order_id)


@app.post("/orders")
def create_order(body):
    return body
''',
    "schema.sql": '''CREATE TABLE customers (id INTEGER PRIMARY KEY, name TEXT NOT NULL);
CREATE TABLE orders (id INTEGER PRIMARY KEY, customer_id INTEGER REFERENCES customers(id), total NUMERIC(10,2));
CREATE INDEX ix_orders ON orders (customer_id);
''',
    "Dockerfile": "FROM python:3.12\nEXPOSE 8000\nCMD [\"python\"]\n",
    "docker-compose.yml": "services:\n  api:\n    build: .\n    depends_on: [db]\n  db:\n    image: postgres:16\n",
    "notifier.ts": "export interface Notifier { send(text: string): void; }\nexport class EmailNotifier implements Notifier {\n  send(text: string): void { deliver(text); }\n}\n",
}


def test_sample_project(spark, make_files, tmp_path):
    a = analyse(spark, make_files(SAMPLE), str(tmp_path / "work"))
    nodes = {r.id: r for r in a.nodes.collect()}
    edges = {(r.source, r.target, r.kind) for r in a.edges.collect()}
    by_name = {(r.kind, r.name) for r in nodes.values()}
    assert {("class", "OrderService"), ("interface", "Repository"), ("interface", "Notifier"), ("class", "EmailNotifier")} <= by_name
    assert ("type:python:OrderRepository", "type:python:Repository", "implements") in edges
    assert nodes["type:python:OrderStatus"].attr.is_state_machine and "NEW" in nodes["type:python:OrderStatus"].attr.members
    assert any(k == "api_endpoint" and "/orders" in n for k, n in by_name)
    assert ("table:orders", "table:customers", "references") in edges
    assert ("container:api", "container:db", "communicates_with") in edges and nodes["container:db"].kind == "database"
    assert ("file:api.py", "file:services.py", "imports") in edges
    row = a.metrics.first()
    assert 0 <= row.base_score <= 100
    card = a.scorecard.first()
    total = sum(r.score_exact * r.weight for r in a.category_scores.collect())
    assert abs(card.overall_exact - total) < 0.01
    actions = a.roadmap.orderBy("rank").collect()
    assert [r.roi for r in actions] == sorted((r.roi for r in actions), reverse=True)
    stats = run_stats(a).first()
    assert stats.files_scanned == 6 and stats.warnings == 0 and a.unindexed.isEmpty()

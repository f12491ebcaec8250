"""Keys, vocabularies and Spark schemas shared by every operator.

Every table is keyed by ``KEYS``: one project at one run.  Ranks, limits and
aggregates that are global in a one-project tool are therefore per key here.
"""

from __future__ import annotations

KEYS = ("project_id", "run_id")

# Node kinds.
NODE_KINDS = (
    "project", "module", "package", "file", "namespace", "class", "interface",
    "abstract_class", "struct", "enum", "function", "method", "service",
    "component", "layer", "database", "table", "api_endpoint", "external_api",
    "queue", "container", "host", "config", "state", "external_package",
    "data_store", "actor",
)
CONTAINER_KINDS = ("module", "package", "file", "namespace")
TYPE_KINDS = ("class", "interface", "abstract_class", "struct", "enum")

# Edge kinds and their display labels.
EDGE_LABELS = {
    "contains": "contains",
    "imports": "imports",
    "uses": "uses",
    "depends_on": "depends on",
    "inherits": "inherits",
    "implements": "implements",
    "composes": "composition",
    "aggregates": "aggregation",
    "associates": "association",
    "calls": "calls",
    "communicates_with": "communicates with",
    "reads": "reads",
    "writes": "writes",
    "exposes": "exposes",
    "deploys": "deploys",
    "transitions_to": "transitions to",
    "references": "references",
}
EDGE_KINDS = tuple(EDGE_LABELS)
SELF_LOOP_KINDS = ("transitions_to", "calls")

# Layers from outermost to innermost.
LAYERS = (
    "presentation", "api", "application", "domain", "data", "infrastructure", "unassigned",
)

# Severity and effort order.
SEVERITIES = ("critical", "high", "medium", "low", "info")
EFFORTS = ("low", "medium", "high")

PARAM = "struct<name:string,type:string>"
METHOD = (
    "struct<name:string,visibility:string,returns:string,"
    f"params:array<{PARAM}>,is_static:boolean,is_abstract:boolean,is_async:boolean>"
)
PROPERTY = "struct<name:string,type:string,visibility:string>"

# Attributes the operators compute with are typed columns; the rest goes to ``extra``.
ATTR = (
    "struct<layer:string,stereotype:string,visibility:string,docstring:string,table:string,"
    "technology:string,complexity:int,loc:int,findings:int,risk_findings:int,debt_markers:int,"
    "change_count:bigint,authors:bigint,is_test:boolean,is_service:boolean,"
    f"is_state_machine:boolean,methods:array<{METHOD}>,properties:array<{PROPERTY}>,"
    f"params:array<{PARAM}>,members:array<string>,extra:map<string,string>>"
)

NODE_SCHEMA = (
    "project_id string, run_id string, id string, kind string, name string, "
    "qualified_name string, file string, module string, language string, "
    f"external boolean, line int, attr {ATTR}"
)
EDGE_SCHEMA = (
    "project_id string, run_id string, source string, target string, kind string, "
    "label string, weight double, attr map<string,string>"
)
REF_SCHEMA = (
    "project_id string, run_id string, source_id string, target_name string, kind string, "
    "language string, hint_module string, attr map<string,string>"
)

NODE_COLUMNS = (
    "id", "kind", "name", "qualified_name", "file", "module", "language", "external", "line", "attr",
)
EDGE_COLUMNS = ("source", "target", "kind", "label", "weight", "attr")
REF_COLUMNS = ("source_id", "target_name", "kind", "language", "hint_module", "attr")

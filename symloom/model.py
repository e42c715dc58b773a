"""The property-graph model: enumerations whose order carries meaning, and schemas."""

from __future__ import annotations

# Fixed values of the data model, in ordinal order.
NODE_KINDS = ("function", "method", "type", "field", "variable", "module", "constant", "macro", "lambda", "entrypoint")
EDGE_KINDS = (
    "calls", "calls-virtual", "calls-closure", "calls-callback", "calls-async", "calls-indirect", "spawns", "contains", "imports", "derives-from",
    "overrides", "implements", "inherits", "references", "instantiates", "throws", "catches", "reads-field", "writes-field",
)
CONDITIONS = ("always", "conditional", "loop", "exception", "panic")
CONFIDENCES = ("possible", "probable", "certain")
TIERS = ("name_syntactic", "scope_graph", "scip", "cha_rta", "points_to")
VISIBILITIES = ("public", "protected", "internal", "package", "private")
ENTRYPOINT_KINDS = ("main", "test", "http-handler", "async-main", "declared")
CUT_MARKERS = ("reflective", "dynamic", "via-di", "via-ffi", "unresolved", "unexpanded-macro", "opaque-call", "truncated-access-path", "summary-budget-exceeded", "external", "untyped-receiver")
EFFECTS = ("blocking", "spawns", "io-file", "io-net", "io-proc", "dynamic-code", "nondeterministic")
TRANSFORMS = ("copy", "projection", "arith", "concat", "composed", "branched", "aggregation", "parse", "serialize", "other")

CALL_FAMILY = EDGE_KINDS[:7]
EXCEPTIONAL = ("exception", "panic")
CALLABLE = ("function", "method", "lambda")

NODE_DDL = (
    "node_id int, kind string, fqn string, file string, line_start int, line_end int, lang string, visibility string, is_abstract boolean, "
    "entrypoint_kind string, signature struct<params:array<struct<name:string,type_text:string,has_default:boolean,variadic:boolean>>,return_type_text:string,"
    "type_params:array<string>,receiver:string>, own_effects int, transitive_effects int, unresolved_calls int, external_calls int, "
    "narrowing struct<typed_out:int,interproc_out:int,visible_out:int,visible_dropped_out:int,typed_away_in:int,interproc_away_in:int,visible_away_in:int>"
)
EDGE_DDL = (
    "edge_id int, src int, dst int, kind string, condition string, confidence string, tier tinyint, rule string, site_id bigint, stmt_index int, "
    "cut_markers array<string>, implicit string, candidate_group int, established_by string, cfg_condition string, macro_origin string, transform string"
)
CANDIDATE_DDL = "candidate_group int, dst int, rank int"

"""Facts of source files: one table per kind, all with the file's path and language."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

DEFS = "path string, lang string, fqn string, kind string, visibility string, scope int, line int, line_end int, is_abstract boolean, arity int, entrypoint_kind string, own_effects int, signature struct<params:array<struct<name:string,type_text:string,has_default:boolean,variadic:boolean>>,return_type_text:string,type_params:array<string>,receiver:string>"
REFS = "path string, lang string, name_path array<string>, scope int, ref_kind string, condition string, line int, col int, stmt_index int, arity int, cut_markers array<string>"
SCOPES = "path string, scope int, parent int, owner_fqn string"
IMPORTS = "path string, scope int, local string, specifier string, exported string"
RELATIONS = "path string, lang string, relation string, subject array<string>, object array<string>, line int"
FLOWS = "path string, fn string, pos int, derived string, derived_version int, source string, transform string, condition string, callee string, args array<string>"


@dataclass
class Facts:
    """imports: what a name means in a scope: specifier is the module, exported the name there (null: the module itself).
    flows: local `derived` (its SSA version after the write) takes its value from local `source`, or from a call of `callee` with `args`."""

    defs: DataFrame
    refs: DataFrame
    scopes: DataFrame
    imports: DataFrame
    relations: DataFrame
    flows: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, **tables: list) -> Facts:
        """Tables from lists of dicts; columns that are missing are null."""
        ddl = {"defs": DEFS, "refs": REFS, "scopes": SCOPES, "imports": IMPORTS, "relations": RELATIONS, "flows": FLOWS}
        out = {}
        for name, schema in ddl.items():
            columns = spark.createDataFrame([], schema).columns
            out[name] = spark.createDataFrame([tuple(row.get(c) for c in columns) for row in tables.get(name, [])], schema)
        return cls(**out)

    def union(self, other: Facts) -> Facts:
        return Facts(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})

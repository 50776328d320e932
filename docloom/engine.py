"""The engine: commands in, lazy DataFrames out."""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, replace
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.types import SPARK_TYPES, FieldDef
from docloom.operators import constraints, ddl, dml, indexes, relationships
from docloom.operators.relationships import Relationship
from docloom.plans import syntax as S
from docloom.plans.parser import parse
from docloom.plans.predicates import compile_filter, conjuncts, fields_of
from docloom.plans.syntax import CommandError
from docloom.sources.journal import Journal
from docloom.sources.storage import FILE, Database, Store

DATABASES = "database_id string, name string, description string, bundles array<string>"


@dataclass(frozen=True)
class CommandResponse:
    """result stays lazy; result_count runs a count when asked."""

    result: DataFrame | None = None
    message: str = ""

    @cached_property
    def result_count(self) -> int:
        return 1 if self.result is None else self.result.count()

    def count_frame(self) -> DataFrame:
        return self.result.agg(F.count("*").alias("result_count"))

    def to_json(self) -> DataFrame:
        """One JSON text per document."""
        return self.result.select(F.to_json(F.struct("*")).alias("document"))


@dataclass(frozen=True)
class Registered:
    """A DataFrame used as a bundle where it lies, without a copy."""

    df: DataFrame
    id_col: str
    fields: tuple = ()


def parse_connection(text: str) -> dict:
    """scheme://host:port:database:user:password"""
    scheme, sep, rest = text.partition("://")
    parts = rest.split(":")
    if not sep or len(parts) != 5:
        raise CommandError("connection strings read scheme://host:port:database:user:password")
    return dict(zip(("scheme", "host", "port", "database", "user", "password"), (scheme, *parts)))


class Engine:
    """Runs commands against registered DataFrames and stored databases.

    semantics: "documented" or "compat" (see docloom.plans.predicates).
    root: folder of the stored databases; without it only registered bundles exist.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, semantics: str = "documented", journal: bool = False):
        if semantics not in ("documented", "compat"):
            raise ValueError(f"unknown semantics: {semantics}")
        self.spark, self.semantics = spark, semantics
        self.store = Store(spark, root) if root else None
        self.database: Database | None = None
        self.registered: dict[str, Registered] = {}
        self.links: dict[str, Relationship] = {}
        self.journal = Journal(spark, f"{root}/_journal") if root and journal else None

    # set-up

    def connect(self, database: str) -> Engine:
        """Use a database, by name or connection string."""
        name = parse_connection(database)["database"] if "://" in database else database
        self.database = self._stored().find(name)
        return self

    def register_bundle(self, name: str, df: DataFrame, id_col: str, fields: tuple = ()) -> Engine:
        self.registered[name] = Registered(df, id_col, tuple(fields))
        return self

    def relate(self, name: str, source: str, target: str, *pairs: tuple[str, str]) -> Engine:
        self.links[name] = Relationship(name, source, target, tuple(pairs))
        return self

    def _stored(self) -> Store:
        if self.store is None:
            raise CommandError("this engine has no root folder for databases")
        return self.store

    def _database(self) -> Database:
        if self.database is None:
            raise CommandError("not connected to a database")
        return self.database

    def _frame(self, bundle: str) -> tuple[DataFrame, str]:
        if bundle in self.registered:
            return self.registered[bundle].df, self.registered[bundle].id_col
        if self.database is None:
            raise CommandError(f"error retrieving bundle '{bundle}': it does not exist")
        return self.database.read(bundle), "DocumentID"

    def _filter(self, expr, df: DataFrame, id_col: str):
        return compile_filter(expr, df.schema, id_col, self.semantics)

    # commands

    def execute(self, command: str) -> CommandResponse:
        parsed = parse(command)
        if self.database is not None and not isinstance(parsed, (S.CreateDatabase, S.DeleteDatabase)):
            self.database.refresh()
        found = getattr(self, "_" + type(parsed).__name__)(parsed)
        if self.journal:
            self.journal.add(command, getattr(parsed, "bundle", getattr(parsed, "name", "") or ""), found.message)
        return found

    def sql(self, command: str) -> DataFrame:
        return self.execute(command).result

    def _SelectDatabases(self, c: S.SelectDatabases) -> CommandResponse:
        found = [self._stored().find(n).manifest for n in self._stored().names() if c.name is None or n.lower() == c.name.lower()]
        return CommandResponse(self.spark.createDataFrame([(m["database_id"], m["name"], m["description"], sorted(m["bundles"])) for m in found], DATABASES))

    def _SelectDocuments(self, c: S.SelectDocuments) -> CommandResponse:
        if c.include:
            return CommandResponse(self._picked(c, self._included(c)))
        df, id_col = self._frame(c.bundle)
        layout = self._covering(c)
        if layout is None:
            df = self._located(c.bundle, c.where, df)
        found = df if layout is None else layout
        kept = found if c.where is None else found.where(self._filter(c.where, found if layout is not None else df, id_col))
        return CommandResponse(self._picked(c, kept))

    def _picked(self, c: S.SelectDocuments, kept: DataFrame) -> DataFrame:
        lacking = [f for f in c.fields if f not in kept.columns]
        if lacking:
            raise CommandError(f"bundle '{c.bundle}' has no field {', '.join(lacking)}")
        return kept.select(*[F.col(f"`{f}`") for f in c.fields]) if c.fields else kept

    def _included(self, c: S.SelectDocuments) -> DataFrame:
        """Parents beside their children.  Conditions on one side filter that side first; those that mix both, by OR, what is joined."""
        df, id_col = self._frame(c.bundle)
        rel = self._relationship(c.bundle, c.include)
        prefix = f"{c.bundle}.{rel.name}."
        own, theirs, mixed = _split_filter(c.where, prefix, self.semantics)
        kept = df if own is None else df.where(self._filter(own, df, id_col))
        children, child_id = self._frame(rel.target)
        joined = relationships.include(kept, children, rel, None if theirs is None else self._filter(theirs, children, child_id))
        if mixed is None:
            return joined
        names = relationships.child_names(kept, children, rel)
        return joined.where(self._filter(_renamed(mixed, prefix, names), joined, id_col))

    def _relationship(self, bundle: str, path: str) -> Relationship:
        name = path.split(".")[-1]
        known = self.links | ({r.name: r for r in self.database.relationships()} if self.database else {})
        if name not in known or known[name].source != bundle:
            raise CommandError(f"bundle '{bundle}' has no relationship '{name}'")
        return known[name]

    def _layouts(self, bundle: str, where) -> list[tuple[dict, list]]:
        """(layout, the conjuncts on its fields) of the secondary layouts that narrow a filter."""
        if bundle in self.registered or self.database is None:
            return []
        found = []
        for entry in self.database.bundle(bundle)["indexes"].values():
            tested = [t for t in conjuncts(where) if t.field in entry["fields"] or t.field == "DocumentID"]
            leading = [t for t in tested if t.field == entry["fields"][0]]
            if leading and (entry["kind"] == "sorted" or any(self._hashable(bundle, t) for t in leading)):
                found.append((entry, tested))
        return found

    def _hashable(self, bundle: str, test: S.Compare) -> bool:
        """Whether the test asks for one key: an equality with a literal of the field's own type."""
        kind = self.database.schema(bundle)[test.field].dataType.typeName()
        own = {"string": str, "long": int, "boolean": bool}.get(kind)
        equality = test.op == "==" or (self.semantics == "compat" and kind in ("string", "boolean"))
        return equality and own is not None and type(test.value) is own

    def _layout_rows(self, bundle: str, entry: dict, where) -> DataFrame:
        """The layout's rows, of a hashed one the bucket of the key that the filter asks for."""
        rows = self.spark.read.parquet(entry["path"])
        if entry["kind"] == "hashed":
            key = next(t for t in conjuncts(where) if t.field == entry["fields"][0] and self._hashable(bundle, t))
            rows = rows.where(F.col(indexes.BUCKET) == self._bucket(bundle, entry, key.value))
        return rows

    def _bucket(self, bundle: str, entry: dict, value):
        kind = self.database.schema(bundle)[entry["fields"][0]].dataType
        return indexes.bucket_of(F.lit(value), kind, entry["buckets"], entry["ignore_case"])

    def _uncovered(self, bundle: str, entry: dict) -> list[dict]:
        """Parts that were added since the layout was written."""
        return [p for p in self.database.bundle(bundle)["parts"] if p["path"] not in entry["parts"]]

    def _covering(self, c: S.SelectDocuments) -> DataFrame | None:
        """A layout that alone has every asked and tested field, with the parts that it does not cover; None without one."""
        if not c.fields:
            return None
        needed = set(c.fields) | fields_of(c.where)
        for entry, _ in self._layouts(c.bundle, c.where):
            has = [*entry["fields"], "DocumentID"]
            if needed <= set(has):
                rows = self._layout_rows(c.bundle, entry, c.where).select(*has)
                later = self._uncovered(c.bundle, entry)
                return rows.unionByName(self.database.read(c.bundle, later).select(*has)) if later else rows
        return None

    def _located(self, bundle: str, where, df: DataFrame) -> DataFrame:
        """df, or what a layout leaves of it: the files that hold a document with the asked keys, and parts not covered."""
        for entry, tested in self._layouts(bundle, where):
            condition = self._filter(S.And(tuple(tested)), df, "DocumentID")
            return self._holding(bundle, entry, self._layout_rows(bundle, entry, where).where(condition))
        return df

    def _holding(self, bundle: str, entry: dict, found: DataFrame) -> DataFrame:
        covered = [p for p in self.database.bundle(bundle)["parts"] if p["path"] in entry["parts"]]
        hit, _ = self.database.holding(bundle, found, covered)
        return self.database.read(bundle, [*hit, *self._uncovered(bundle, entry)])

    def lookup(self, bundle: str, name: str, *values) -> DataFrame:
        """The documents with these keys, found through a layout: of a sorted one all its fields or the first ones."""
        entry = self._index_entry(bundle, name)
        rows, keys = self.spark.read.parquet(entry["path"]), entry["fields"]
        if entry["kind"] == "sorted":
            asked = indexes.equal(keys, list(values))
        else:
            rows = rows.where(F.col(indexes.BUCKET) == self._bucket(bundle, entry, values[0]))
            asked = indexes.hash_key(F.col(keys[0]), entry["ignore_case"]) == indexes.hash_key(F.lit(values[0]), entry["ignore_case"])
        return self._holding(bundle, entry, rows.where(asked)).where(asked)

    def lookup_between(self, bundle: str, name: str, start: list | None = None, end: list | None = None) -> DataFrame:
        """The documents whose keys are in a closed interval in the layout's order; None leaves a side open."""
        entry = self._index_entry(bundle, name)
        if entry["kind"] != "sorted":
            raise CommandError(f"index '{name}' has no order")
        asked = indexes.within(entry["fields"], start, end) & F.col(entry["fields"][0]).isNotNull()
        return self._holding(bundle, entry, self.spark.read.parquet(entry["path"]).where(asked)).where(asked)

    def _CreateDatabase(self, c: S.CreateDatabase) -> CommandResponse:
        self._stored().create(c.name)
        return CommandResponse(message=f"Database '{c.name}' created successfully.")

    def _UpdateDatabase(self, c: S.UpdateDatabase) -> CommandResponse:
        self._stored().find(c.name).save()
        return CommandResponse(message=f"Database '{c.name}' updated successfully.")

    def _DeleteDatabase(self, c: S.DeleteDatabase) -> CommandResponse:
        self._stored().drop(c.name)
        if self.database is not None and self.database.name.lower() == c.name.lower():
            self.database = None
        return CommandResponse(message=f"Database '{c.name}' deleted successfully.")

    def _CreateBundle(self, c: S.CreateBundle) -> CommandResponse:
        db = self._database()
        if len({f.name for f in c.fields}) < len(c.fields):
            raise CommandError(f"bundle '{c.name}' declares a field twice")
        db.create_bundle(c.name, list(c.fields))
        return CommandResponse(message=f"Bundle '{c.name}' created successfully in database '{db.name}'.")

    def _UpdateBundle(self, c: S.UpdateBundle) -> CommandResponse:
        for x in c.changes:
            if isinstance(x, S.CreateRelationship):
                self._create_relationship(x)
            elif isinstance(x, S.DeleteRelationship):
                self._delete_relationship(x.name)
        changes = [x for x in c.changes if isinstance(x, (S.AddField, S.ChangeField, S.RemoveField))]
        if not changes:
            return CommandResponse(message=f"Bundle '{c.name}' updated successfully.")
        df, _ = self._frame(c.name)
        for x in changes:
            df = ddl.apply_change(df, x)
        message = f"Bundle '{c.name}' updated successfully."
        if c.name in self.registered:
            self.registered[c.name] = replace(self.registered[c.name], df=df)
            return CommandResponse(df, message)
        fields = self.database.fields(c.name)
        for x in changes:
            if isinstance(x, S.AddField):
                fields.append(x.new)
            elif isinstance(x, S.ChangeField):
                fields = [x.new if f.name == x.old else f for f in fields]
            else:
                fields = [f for f in fields if f.name != x.old]
        touched = {x.new.name for x in changes if not isinstance(x, S.RemoveField)}
        constraints.check_new(None, df, [f for f in fields if f.name in touched])
        noted = self._noted(c.name, changes)
        if noted is None:
            self.database.commit(c.name, df, fields)
        else:
            self.database.set_fields(c.name, fields, *noted)
        return CommandResponse(message=message)

    def _noted(self, bundle: str, changes: list) -> tuple[dict, list[dict]] | None:
        """(undeclared fields, parts) after the changes, if notes on the parts express them: no value is cast."""
        entry = deepcopy(self.database.bundle(bundle))
        undeclared, parts, schema = entry["undeclared"], entry["parts"], self.database.schema(bundle)
        kinds = {f.name: f.dataType for f in schema}
        for x in changes:
            if isinstance(x, S.ChangeField) and (kinds[x.old] != x.new.spark_type or x.new.default is not None or x.new.type == "DATETIME"):
                return None
            if isinstance(x, S.AddField) and x.new.type == "DATETIME":
                return None
            old, new = getattr(x, "old", None), None if isinstance(x, S.RemoveField) else x.new.name
            for part in parts:
                lacks, value = old in part["filled"], part["filled"].pop(old, None)
                stored = part["renamed"].pop(old, old)
                if isinstance(x, S.AddField):
                    part["filled"][new] = ddl.first_value(x.new)
                elif isinstance(x, S.ChangeField) and lacks:
                    part["filled"][new] = value
                elif isinstance(x, S.ChangeField) and stored != new:
                    part["renamed"][new] = stored
            undeclared.pop(old, None)
            kinds.pop(old, None)
            if new:
                kinds[new] = x.new.spark_type
        return undeclared, parts

    def _create_relationship(self, x: S.CreateRelationship, anew: bool = False) -> None:
        for side, bundle in enumerate((x.source, x.target)):
            kinds = {f.name: f.dataType for f in self._frame(bundle)[0].schema}
            lacking = [p[side] for p in x.pairs if p[side] not in kinds]
            if lacking:
                raise CommandError(f"bundle '{bundle}' has no field {', '.join(lacking)}")
            for pair, types in zip(x.pairs, x.types):
                declared = SPARK_TYPES.get(types[side].upper())
                if declared is None or declared != kinds[pair[side]]:
                    raise CommandError(f"field '{pair[side]}' of bundle '{bundle}' is {kinds[pair[side]].simpleString()}, not {types[side]}")
        rel = Relationship(x.name, x.source, x.target, x.pairs)
        if self.database is None or x.source in self.registered or x.target in self.registered:
            if (x.name in self.links) != anew:
                raise CommandError(f"relationship '{x.name}' " + ("does not exist" if anew else "already exists"))
            self.links[x.name] = rel
            return
        known = self.database.manifest["relationships"]
        if any(r["name"] == x.name for r in known) != anew:
            raise CommandError(f"relationship '{x.name}' " + ("does not exist" if anew else "already exists"))
        self.database.manifest["relationships"] = [*(r for r in known if r["name"] != x.name), rel.as_dict()]
        self.database.save()

    def _UpdateRelationship(self, c: S.UpdateRelationship) -> CommandResponse:
        self._create_relationship(c.made, anew=True)
        return CommandResponse(message=f"Relationship '{c.made.name}' updated successfully.")

    def _delete_relationship(self, name: str) -> None:
        if self.links.pop(name, None) is not None:
            return
        known = self._database().manifest["relationships"]
        if all(r["name"] != name for r in known):
            raise CommandError(f"relationship '{name}' does not exist")
        self._database().manifest["relationships"] = [r for r in known if r["name"] != name]
        self._database().save()

    def _DeleteBundle(self, c: S.DeleteBundle) -> CommandResponse:
        if c.name in self.registered:
            bound = [r.name for r in self.links.values() if c.name in (r.source, r.target)]
            if bound:
                raise CommandError(f"bundle '{c.name}' has relationships: {', '.join(bound)}")
            del self.registered[c.name]
        else:
            self._database().drop_bundle(c.name)
        return CommandResponse(message=f"Bundle '{c.name}' deleted successfully.")

    def _CreateIndex(self, c: S.CreateIndex) -> CommandResponse:
        """On stored bundles the layout is written and recorded; on registered ones it is returned lazily."""
        df, id_col = self._frame(c.bundle)
        lacking = [f for f in c.fields if f not in df.columns]
        if lacking:
            raise CommandError(f"bundle '{c.bundle}' has no field {', '.join(lacking)}")
        if c.kind == "hashed" and len(c.fields) != 1:
            raise CommandError("a hashed index has one field")
        if c.unique and not df.dropna(subset=list(c.fields)).groupBy(*c.fields).count().where("count > 1").isEmpty():
            raise CommandError(f"duplicate key in unique index '{c.name}'")
        if c.bundle in self.registered:
            return CommandResponse(self._layout(df, c.kind, list(c.fields), [id_col], c.ignore_case)[0], f"Index '{c.name}' created successfully.")
        if c.name in self.database.bundle(c.bundle)["indexes"]:
            raise CommandError(f"index '{c.name}' already exists")
        self._write_index(c.bundle, c.name, {"kind": c.kind, "fields": list(c.fields), "unique": c.unique, "ignore_case": c.ignore_case})
        return CommandResponse(message=f"Index '{c.name}' created successfully.")

    @staticmethod
    def _layout(df: DataFrame, kind: str, keys: list[str], ids: list[str], ignore_case: bool) -> tuple[DataFrame, int]:
        """(layout, buckets)"""
        if kind == "sorted":
            return indexes.sorted_copy(df, keys, ids), 0
        buckets = indexes.bucket_count(df.count())
        return indexes.hashed_copy(df, keys[0], ids, buckets, ignore_case), buckets

    def _write_index(self, bundle: str, name: str, about: dict) -> None:
        """Write the layout of all parts there are and put it in force; a hashed one has buckets for their rows."""
        entry = deepcopy(self.database.bundle(bundle))
        rows = self.database.read(bundle, with_file=True)
        layout, buckets = self._layout(rows, about["kind"], about["fields"], ["DocumentID", FILE], about["ignore_case"])
        path = f"{self.database.path}/{bundle}/index-{uuid4().hex}"
        write = layout.write.partitionBy(indexes.BUCKET) if buckets else layout.write
        write.parquet(path)
        entry["indexes"][name] = about | {"path": path, "buckets": buckets, "parts": [p["path"] for p in entry["parts"]]}
        self.database.manifest["bundles"][bundle] = entry
        self.database.save()

    def refresh_index(self, bundle: str, name: str) -> Engine:
        """Write a layout anew, so that it covers what was added since, with as many buckets as the rows ask for."""
        known = self._index_entry(bundle, name)
        self._write_index(bundle, name, {k: known[k] for k in ("kind", "fields", "unique", "ignore_case")})
        return self

    def list_indexes(self, bundle: str) -> DataFrame:
        known = self._database().bundle(bundle)["indexes"]
        return self.spark.createDataFrame([(n, x["kind"], x["fields"], x["unique"]) for n, x in known.items()], "name string, kind string, fields array<string>, unique boolean")

    def _index_entry(self, bundle: str, name: str) -> dict:
        known = self._database().bundle(bundle)["indexes"]
        if name not in known:
            raise CommandError(f"index '{name}' does not exist")
        return known[name]

    def drop_index(self, bundle: str, name: str) -> None:
        path = self._index_entry(bundle, name)["path"]
        del self._database().bundle(bundle)["indexes"][name]
        self.database.save()
        self.database.files.remove(path)

    def index(self, bundle: str, name: str) -> DataFrame:
        """The layout itself, for the lookups of docloom.operators.indexes."""
        return self.spark.read.parquet(self._index_entry(bundle, name)["path"]).drop(indexes.BUCKET, FILE)

    def vacuum(self, bundle: str) -> int:
        """Delete data and layouts of this bundle that are no longer in force; how many folders."""
        return self._database().vacuum(bundle)

    def compact(self, bundle: str) -> Engine:
        """Write all parts of a bundle as one; its layouts are dropped."""
        db = self._database()
        db.commit(bundle, db.read(bundle), db.fields(bundle))
        return self

    def bundle_fields(self, bundle: str) -> DataFrame:
        """A row per field: its type and declared flags."""
        df, _ = self._frame(bundle)
        declared = {f.name: f for f in (self.registered[bundle].fields if bundle in self.registered else self.database.fields(bundle))}
        rows = [(f.name, f.dataType.simpleString(), *((d.required, d.unique, None if d.default is None else str(d.default)) if (d := declared.get(f.name)) else (False, False, None))) for f in df.schema]
        return self.spark.createDataFrame(rows, "field string, type string, required boolean, unique boolean, default_value string")

    def export_documents(self, bundle: str) -> DataFrame:
        """Documents in the exchange shape: (Name, DocumentId, Fields) with one entry per field, values as text."""
        df, id_col = self._frame(bundle)
        declared = {f.name: f for f in (self.registered[bundle].fields if bundle in self.registered else self.database.fields(bundle))}

        def entry(f):
            d = declared.get(f.name)
            default = F.lit(None if d is None or d.default is None else str(d.default)).cast("string")
            value = F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("struct", "map", "array", "variant") else F.col(f"`{f.name}`").cast("string")
            return F.struct(F.lit(f.name).alias("Name"), F.lit(f.dataType.simpleString()).alias("Type"), value.alias("Value"), default.alias("DefaultValue"), F.lit(bool(d and d.required)).alias("Required"), F.lit(bool(d and d.unique)).alias("Unique"))

        return df.select(F.lit(bundle).alias("Name"), F.col(id_col).cast("string").alias("DocumentId"), F.array(*[entry(f) for f in df.schema if f.name != id_col]).alias("Fields"))

    def cache_bundle(self, bundle: str) -> Engine:
        """Keep a registered bundle in executor memory, spilling to their disks, until uncache_bundle."""
        self.registered[bundle].df.persist()
        return self

    def uncache_bundle(self, bundle: str) -> Engine:
        self.registered[bundle].df.unpersist()
        return self

    def _AddDocument(self, c: S.AddDocument) -> CommandResponse:
        df, id_col = self._frame(c.bundle)
        return self.add_documents(c.bundle, dml.one_row(df, {id_col if n.lower() == "documentid" else n: v for n, v in c.values.items()}))

    def add_documents(self, bundle: str, rows: DataFrame) -> CommandResponse:
        """Add many documents in one write: defaults are filled and the declared rules checked once."""
        message = f"Document added successfully to bundle '{bundle}'."
        if self.database is not None:
            self.database.refresh()
        df, id_col = self._frame(bundle)
        if bundle in self.registered:
            entry = self.registered[bundle]
            rows = constraints.fill_required(rows, list(entry.fields))
            if entry.fields:
                constraints.check_new(df, rows, list(entry.fields))
            grown = dml.add_rows(df, rows)
            self.registered[bundle] = replace(entry, df=grown)
            return CommandResponse(grown, message)
        fields = self.database.fields(bundle)
        for f in fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.spark_type))
        now = F.current_timestamp().cast("timestamp_ntz")
        named = id_col in rows.columns
        given = rows[id_col].cast("string") if named else F.lit(None).cast("string")
        made = {n: now if n not in rows.columns else F.coalesce(rows[n], now) for n in ("CreatedAt", "UpdatedAt")}
        rows = constraints.typed(rows, fields)
        rows = constraints.fill_required(rows.withColumns({id_col: F.coalesce(given, F.expr("uuid()")), **made}), fields)
        ids = [FieldDef(id_col, "STRING", unique=True)] if named else []  # ids made here do not meet
        constraints.check_new(df, rows, [*fields, *ids])
        self.database.append(bundle, rows)
        return CommandResponse(message=message)

    def _UpdateDocuments(self, c: S.UpdateDocuments) -> CommandResponse:
        df, id_col = self._frame(c.bundle)
        where, message = self._filter(c.where, df, id_col), f"Documents updated in bundle '{c.bundle}'."

        def changed(rows: DataFrame) -> DataFrame:
            return dml.update(rows, c.values, where, "UpdatedAt") if self.semantics == "documented" else dml.update_raw(rows, c.raw, where)

        if c.bundle in self.registered:
            return self._replaced(c.bundle, changed(df), message)
        fields, touched = self.database.fields(c.bundle), c.raw if self.semantics == "compat" else c.values
        constraints.check_new(None, changed(df), [f for f in fields if f.name in touched])
        if self.semantics == "documented":
            return self._rewritten(c.bundle, where, changed, message)
        # Fields that now hold written text change their type, so all parts are written anew.
        fields = [replace(f, type="STRING", default=None if f.default is None else str(f.default)) if f.name in c.raw else f for f in fields]
        self.database.commit(c.bundle, changed(df), fields)
        return CommandResponse(message=message)

    def _DeleteDocuments(self, c: S.DeleteDocuments) -> CommandResponse:
        df, id_col = self._frame(c.bundle)
        where, message = self._filter(c.where, df, id_col), f"Documents deleted from bundle '{c.bundle}'."
        if c.bundle in self.registered:
            return self._replaced(c.bundle, dml.delete(df, where), message)
        return self._rewritten(c.bundle, where, lambda rows: dml.delete(rows, where), message)

    def _replaced(self, bundle: str, df: DataFrame, message: str) -> CommandResponse:
        self.registered[bundle] = replace(self.registered[bundle], df=df)
        return CommandResponse(df, message)

    def _rewritten(self, bundle: str, where, change, message: str) -> CommandResponse:
        """Write the files that hold a match anew, changed; other files stay as they are."""
        db = self.database
        hit, rest = db.holding(bundle, db.read(bundle, with_file=True).where(where))
        if hit:
            db.commit(bundle, change(db.read(bundle, hit)), keep=rest)
        return CommandResponse(message=message)


def _split_filter(expr, prefix: str, semantics: str):
    """(own, children's, mixed) filters of an INCLUDE, by the fields that each conjunct tests; children's without ``prefix``."""
    items = list(expr.items) if isinstance(expr, S.And) or (isinstance(expr, S.Or) and semantics == "compat") else [] if expr is None else [expr]
    sides = ([], [], [])
    for x in items:
        of_children = [f.startswith(prefix) for f in fields_of(x)]
        sides[0 if not any(of_children) else 1 if all(of_children) else 2].append(x)
    whole = [None if not parts else parts[0] if len(parts) == 1 else S.And(tuple(parts)) for parts in sides]
    return whole[0], _renamed(whole[1], prefix, {}), whole[2]


def _renamed(expr, prefix: str, names: dict[str, str]):
    """expr with children's fields as they are called in names, or without ``prefix``."""
    if isinstance(expr, S.Compare):
        own = expr.field.removeprefix(prefix)
        return replace(expr, field=names.get(own, own)) if expr.field.startswith(prefix) else expr
    return None if expr is None else replace(expr, items=tuple(_renamed(x, prefix, names) for x in expr.items))

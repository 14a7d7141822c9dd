"""State tables changed by whole-set jobs: next = f(current, changes).

Parquet has no MERGE or DELETE, so every operator returns the next version as a
DataFrame; callers write it to a new version directory (``sources.files.write_version``)
and never overwrite the version they read. All operators are joins and
aggregates on the key: they shuffle once per input and never collect.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from valorum.operators.latest import latest_per_key

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
# Seed merge: columns the user edits (kept on re-seed) and columns the seed refreshes.
SEED_KEEP = ("nome", "setor", "subsetor", "segmento", "perfil", "tamanho", "gov", "ctrl", "modelo", "tags")
SEED_REFRESH = ("cd_cvm", "monitored", "lpa", "payout", "liquidez", "roe_i", "g1", "ke", "gp")
# Columns a partial update may change.
EDIT_FIELDS = ("nome", "setor", "subsetor", "segmento", "perfil", "tamanho", "gov", "ctrl", "modelo", "tags")
STATUS_INSERTED = "inserted"
STATUS_DUPLICATE = "duplicate"
STATUS_INVALID = "invalid"
MSG_REQUIRED = "ticker e nome obrigatórios"
MSG_DUPLICATE = "ticker já cadastrado"
MSG_NOTHING = "nada para atualizar"
MSG_NOT_FOUND = "ticker não encontrado"
# ---------------------------------------------------------------------------


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def delete_keys(current: DataFrame, keys: DataFrame, key="ticker") -> DataFrame:
    """Rows of ``current`` whose key is not in ``keys``."""
    k = _keys(key)
    return current.join(keys.select(*k), k, "left_anti")


def seed_minus_removed(seed: DataFrame, removed: DataFrame, key="ticker") -> DataFrame:
    """The seed without vetoed keys."""
    return delete_keys(seed, removed, key)


def insert_ignore(current: DataFrame, changes: DataFrame, key="ticker", order_by: Sequence | None = None) -> DataFrame:
    """M3 / M8: insert rows whose key is absent; present keys keep their row.

    Several changes for one new key: the first under ``order_by`` (ascending) wins;
    without ``order_by`` the changes must be unique per key (key-only tables).
    """
    k = _keys(key)
    ch = changes
    if order_by:
        ch = latest_per_key(ch, k, [(c, "asc") for c in order_by], columns=[c for c in current.columns if c not in k])
    else:
        ch = ch.select(*current.columns).dropDuplicates(k)
    new = ch.join(current.select(*k), k, "left_anti")
    return current.unionByName(new.select(*current.columns))


def upsert_latest(current: DataFrame, changes: DataFrame, key="ticker", order_by: Sequence = ()) -> DataFrame:
    """M2: the newest row per key among the current table and the changes; other rows stay.

    Newest by ``order_by``, as in the streams: if the current table carries those columns, a change
    that arrives late does not replace a newer current row (equal ones: the change wins). If it does
    not, every change is newer than the table.
    """
    k = _keys(key)
    cols = [c for c in current.columns if c not in k]
    newest = latest_per_key(changes, k, list(order_by), columns=[c for c in changes.columns if c not in k])
    newest = newest.select(*k, *[F.col(c) if c in newest.columns else F.lit(None).cast(current.schema[c].dataType).alias(c)
                                 for c in cols])
    names = [c[0] if isinstance(c, tuple) else c for c in order_by]
    if order_by and all(isinstance(c, str) and c in current.columns for c in names):
        both = current.withColumn("_change", F.lit(0)).unionByName(newest.withColumn("_change", F.lit(1)))
        return latest_per_key(both, k, [*order_by, "_change"], columns=cols).select(*current.columns)
    return current.join(newest.select(*k), k, "left_anti").unionByName(newest)


def merge_seed(current: DataFrame, seed: DataFrame, removed: DataFrame, key: str = "ticker",
               keep: Sequence[str] = SEED_KEEP, refresh: Sequence[str] = SEED_REFRESH,
               user_col: str = "user") -> DataFrame:
    """M1: re-seed: insert new keys, refresh ``refresh`` columns of existing keys, keep ``keep``
    columns as the user left them, skip vetoed keys (Q9). New rows get ``user = 0``."""
    s = seed_minus_removed(seed, removed, key)
    c = current.withColumn("_in_c", F.lit(True))
    s = s.withColumn("_in_s", F.lit(True))
    cs = c.alias("c")
    ss = s.alias("s")
    j = cs.join(ss, F.col(f"c.{key}") == F.col(f"s.{key}"), "full")
    in_c = F.coalesce(F.col("c._in_c"), F.lit(False))
    in_s = F.coalesce(F.col("s._in_s"), F.lit(False))
    out = [F.coalesce(F.col(f"c.{key}"), F.col(f"s.{key}")).alias(key)]
    for col in current.columns:
        if col in (key, user_col):
            continue
        if col in refresh and col in seed.columns:
            out.append(F.when(in_s, F.col(f"s.{col}")).otherwise(F.col(f"c.{col}")).alias(col))
        elif col in seed.columns:
            out.append(F.when(in_c, F.col(f"c.{col}")).otherwise(F.col(f"s.{col}")).alias(col))
        else:
            out.append(F.col(f"c.{col}").alias(col))
    if user_col in current.columns:
        out.append(F.when(in_c, F.col(f"c.{user_col}")).otherwise(F.lit(0)).alias(user_col))
    return j.select(*out)


def patch_columns(current: DataFrame, changes: DataFrame, key: str = "ticker", fields: str = "fields",
                  allowed: Sequence[str] = EDIT_FIELDS, order_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M5: partial updates of whitelisted columns sent in changes (``fields`` MAP<STRING,STRING>).

    All changes of a key apply in the order of ``order_by`` (required; a total order), column by column:
    each column ends with the last value sent for it, whatever other changes send. A sent NULL becomes ''
    (blank; '[]' for the JSON tags). Returns (next, status) with one status row per change, key and ordering
    columns first: 'ok', 'nada para atualizar' or 'ticker não encontrado'.
    """
    order = list(order_by)
    if not order:
        raise ValueError("patch_columns needs order_by: several changes of one key apply in order")
    cols = [c for c in allowed if c in current.columns]
    # A change without a map sends nothing.
    m = F.coalesce(F.map_filter(F.col(fields), lambda k, v: k.isin(*allowed)), F.create_map().cast("map<string,string>"))
    ch = changes.select(key, *order, m.alias("_m"))
    when = F.struct(*[F.col(c) for c in order])

    def last_sent(col: str) -> Column:
        blank = F.lit("[]") if col == "tags" else F.lit("")  # tags are JSON text
        value = F.struct(F.coalesce(F.col("_m")[col], blank).alias("v"))
        return F.max_by(value, F.when(F.map_contains_key("_m", col), when)).alias(f"_p_{col}")

    patches = ch.where(F.size("_m") > 0).groupBy(key).agg(*[last_sent(c) for c in cols])
    sets = {c: F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}")["v"]).otherwise(F.col(c)) for c in cols}
    nxt = current.join(patches, key, "left").withColumns(sets).select(*current.columns)
    present = current.select(key).distinct().withColumn("_found", F.lit(True))
    st = ch.join(present, key, "left").select(
        key, *order,
        F.when(F.size("_m") == 0, F.lit(MSG_NOTHING))
        .when(F.col("_found").isNull(), F.lit(MSG_NOT_FOUND)).otherwise(F.lit("ok")).alias("status"))
    return nxt, st


def cascade_delete(tables: Mapping[str, DataFrame], keys: DataFrame, tombstones: DataFrame,
                   key: str = "ticker") -> dict[str, DataFrame]:
    """M6: delete the keys from every table and record them as tombstones (M3)."""
    out = {name: delete_keys(df, keys, key) for name, df in tables.items()}
    out["removed"] = insert_ignore(tombstones.select(key), keys.select(key).distinct(), key)
    return out


def clear_tombstones(tombstones: DataFrame, added: DataFrame, key: str = "ticker") -> DataFrame:
    """M7: re-added keys lose their tombstone."""
    return delete_keys(tombstones, added, key)


def evolve_schema(df: DataFrame, schema: StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """M9: align to ``schema``: existing columns cast, missing ones added with their default (or NULL)."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def stored_key(df: DataFrame, key: str) -> DataFrame:
    """Text keys as they are stored: upper-case."""
    return df.withColumn(key, F.upper(key)) if dict(df.dtypes).get(key) == "string" else df


def insert_status(current: DataFrame, requests: DataFrame, key: str = "ticker",
                  required: Sequence[str] = ("ticker", "nome"), order_by: Sequence[str] = ()) -> DataFrame:
    """J10 + P8: per request 'inserted', 'duplicate' (key exists) or 'invalid' (required field blank).

    Requests apply in the order of ``order_by`` (required; a total order): of several valid ones for a new
    key the first is inserted, the others are duplicates. Text keys are upper-cased.
    """
    if not order_by:
        raise ValueError("insert_status needs order_by: the first request for a key wins")
    requests = stored_key(requests, key)
    missing = None
    for c in required:
        blank = F.col(c).isNull() | (F.col(c).cast("string") == "")
        missing = blank if missing is None else (missing | blank)
    present = current.select(key).distinct().withColumn("_exists", F.lit(True))
    # Only the first valid request of a key is marked: a key with very many requests ships one row per task.
    valid = requests.where(~missing).select(key, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)])
    first = latest_per_key(valid, key, [(f"_o{i}", "asc") for i in range(len(order_by))])
    j = requests.join(present, key, "left").join(first, key, "left")
    is_first = F.lit(True)
    for i, c in enumerate(order_by):
        is_first = is_first & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    taken = F.col("_exists").isNotNull() | ~is_first
    return j.withColumns({
        "status": F.when(missing, F.lit(STATUS_INVALID)).when(taken, F.lit(STATUS_DUPLICATE))
        .otherwise(F.lit(STATUS_INSERTED)),
        "error": F.when(missing, F.lit(MSG_REQUIRED)).when(taken, F.lit(MSG_DUPLICATE)),
    }).drop("_exists", *[f"_o{i}" for i in range(len(order_by))])


def add_entities(current: DataFrame, requests: DataFrame, defaults: Mapping[str, object], key: str = "ticker",
                 order_by: Sequence[str] = (), tombstones: DataFrame | None = None
                 ) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Insert valid, new requests with defaults for absent values, marked user-created.

    Text keys are upper-cased; a tag array is stored as JSON text; ``defaults`` fills NULL request values per column.
    Requests apply in the order of ``order_by`` (see :func:`insert_status`). Returns (next, statuses,
    tombstones without the keys that were added).
    """
    req = requests
    if "tags" in req.columns and dict(req.dtypes)["tags"].startswith("array"):
        req = req.withColumn("tags", F.coalesce(F.to_json("tags"), F.lit("[]")))
    st = insert_status(current, req, key, order_by=order_by)
    ok = st.where(F.col("status") == STATUS_INSERTED)
    cols = []
    for f in current.schema.fields:
        if f.name in ok.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    new = ok.select(*cols)
    left = None if tombstones is None else clear_tombstones(tombstones, new, key)
    return current.unionByName(new), st.select(key, *order_by, "status", "error"), left

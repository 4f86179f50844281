"""Table maintenance as snapshot jobs.

Parquet tables have no row-level UPDATE/DELETE/MERGE in open-source
Spark, so each operator takes the current snapshot and a table of changes
and returns the next snapshot (plus the rejected changes); the caller
writes it as a new version (``bodega.sources.tables.write_snapshot``).
A catalog with row-level operations can run the same logic as MERGE INTO.

Changes carry ``change_seq``; when a key has several, they apply in that
order, which is what sending them one by one would do.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodega.functions.exprs import falsy_number, falsy_text, or_default_number, or_default_text, ts
from bodega.functions.sequence import following, hot_keys, may_have_hot_groups, number_rows, reliable_checkpoint

SEQ = "change_seq"


def _reject(df: DataFrame, key: str, reason: Column | str) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(F.col(key), F.col(SEQ), r.alias("reason"))


# ---- W1 -------------------------------------------------------------------
def assign_ids(base: DataFrame, new: DataFrame, key: str, order_by: Sequence = (SEQ,)) -> DataFrame:
    """Next identity values: max(key) + rank in ``order_by`` order.

    The rank is computed range-partitioned (partition counts + offsets), not
    by one global window that would pull every new row into one task."""
    start = base.select(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    numbered = number_rows(new.drop(key) if key in new.columns else new, [], list(order_by), "_rn")
    return numbered.withColumn(key, (start + F.col("_rn")).cast(base.schema[key].dataType)).drop("_rn")


def insert_rows(base: DataFrame, new: DataFrame, key: str, order_by: Sequence = (SEQ,)) -> tuple[DataFrame, DataFrame]:
    """Append with new identity values -> (snapshot, inserted rows with their keys)."""
    inserted = assign_ids(base, new, key, order_by)
    cols = [c for c in inserted.columns if c != SEQ]
    snapshot = base.unionByName(inserted.select(*cols), allowMissingColumns=True)
    return snapshot, inserted


# ---- W2 / W3 --------------------------------------------------------------
def latest_change(changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The last change per key (max ``change_seq``); partial aggregation keeps
    a key with very many changes cheap."""
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*columns, SEQ), F.col(SEQ)).alias("_n")
    ).select(key, *[F.col(f"_n.{c}").alias(c) for c in list(columns) + [SEQ]])


def update_rows(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str],
                stamp: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace ``columns`` where the key matches (an explicit NULL overwrites).

    Returns (snapshot, rejects); rejects are changes whose key is missing."""
    latest = latest_change(changes, key, columns).withColumn("_hit", F.lit(True))
    renamed = latest.select(key, "_hit", *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = base.join(renamed, key, "left")
    stamp = stamp or {}
    out = []
    for c in base.columns:
        if c in columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c))
        elif c in stamp:
            out.append(F.when(F.col("_hit"), stamp[c]).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    snapshot = j.select(*out)
    missing = changes.where(F.col(key).isNotNull()).join(base.select(key), key, "left_anti")
    nulls = changes.where(F.col(key).isNull())
    rejects = _reject(missing, key, "not_found").unionByName(_reject(nulls, key, "missing_key"))
    return snapshot, rejects


def partial_update(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Only supplied (non-NULL) fields change; a change supplying none is rejected.

    Applying changes one by one leaves, per column, the latest supplied
    value: ``max_by(value, seq)`` over the rows where the value is present."""
    supplied = F.lit(False)
    for c in columns:
        supplied = supplied | F.col(c).isNotNull()
    empty = changes.where(~supplied)
    nulls = changes.where(supplied & F.col(key).isNull())
    usable = changes.where(supplied & F.col(key).isNotNull())
    latest = usable.groupBy(key).agg(
        F.lit(True).alias("_hit"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(f"_new_{c}") for c in columns])
    j = base.join(latest, key, "left")
    snapshot = j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).cast(base.schema[c].dataType).alias(c)
                          if c in columns else F.col(c) for c in base.columns])
    missing = usable.join(base.select(key), key, "left_anti")
    rejects = (_reject(empty, key, "nothing_to_update").unionByName(_reject(missing, key, "not_found"))
               .unionByName(_reject(nulls, key, "missing_key")))
    return snapshot, rejects


# ---- W4-W7 ----------------------------------------------------------------
def delete_rows(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop the listed keys."""
    return base.join(keys.select(key), key, "left_anti")


def guarded_delete(base: DataFrame, keys: DataFrame, key: str, ref: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    """Drop only keys nothing refers to; the others are rejected with the
    number of referring rows. The reference count is a grouped count with
    map-side combining, so a key referred to by a third of ``ref`` costs one
    partial count per partition, not a third of the data in one task."""
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    refs = (ref.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(key))
            .agg(F.count(F.lit(1)).alias("ref_count")))
    blocked = asked.join(refs, key)
    kept = base.join(asked.join(blocked.select(key), key, "left_anti"), key, "left_anti")
    rejects = blocked.select(key, F.col("ref_count").cast("long"), F.lit("referenced").alias("reason"))
    return kept, rejects


def cascade_delete(orders: DataFrame, lines: DataFrame, keys: DataFrame, key: str = "ID_TomaPedido") -> tuple[DataFrame, DataFrame]:
    """Dropping orders drops their lines."""
    k = keys.select(key).distinct()
    return orders.join(k, key, "left_anti"), lines.join(k, key, "left_anti")


def insert_if_absent(base: DataFrame, new: DataFrame, natural_key: Sequence[str], key: str,
                     order_by: Sequence = (SEQ,)) -> tuple[DataFrame, DataFrame]:
    """Add rows whose natural key is not there yet (first of each key
    in ``order_by`` order); idempotent. A NULL equals nothing, so rows whose
    key holds one are all added. -> (snapshot, inserted)."""
    nk = list(natural_key)
    whole = F.lit(True)
    for c in nk:
        whole = whole & F.col(c).isNotNull()
    loose, new = new.where(~whole), new.where(whole)
    cols = [c for c in new.columns if c not in nk]
    first = new.groupBy(*nk).agg(F.min_by(F.struct(*cols), F.struct(*[F.col(c) for c in order_by])).alias("_r"))
    first = first.select(*nk, *[F.col(f"_r.{c}").alias(c) for c in cols])
    absent = first.join(base.select(*nk).where(F.col(nk[0]).isNotNull()).distinct(), nk, "left_anti")
    absent = absent.unionByName(loose.select(*absent.columns))
    return insert_rows(base, absent, key, order_by)


# ---- W8-W13: field defaults of each master table ---------------------------
PRODUCT_FIELDS = ["Descripcion", "Pr_Ean13", "PrecioFinalUni", "Stock", "ID_Proveedor", "ID_Rubro", "idMarca",
                  "IdAlicIva", "Costo", "CostoUnit", "margen", "PrecioFinalPack", "PrecioNetoPack",
                  "PrecioNetoUni", "MontoIVA", "PMR", "Pr_Pack", "Pr_UniXPack", "Estado", "PermiteDescuento"]
# The defaults the reference applies to a missing field.
PRODUCT_NUMBER_DEFAULTS = {"PrecioFinalUni": 0, "Stock": 0, "ID_Rubro": 1, "Costo": 0, "CostoUnit": 0,
                           "margen": 0, "PrecioFinalPack": 0, "PrecioNetoPack": 0, "PrecioNetoUni": 0,
                           "MontoIVA": 0, "PMR": 1, "Pr_UniXPack": 1}
PRODUCT_TEXT_DEFAULTS = {"Pr_Pack": "UN", "Estado": "Activo"}
PRODUCT_NULL_IF_FALSY = {"Pr_Ean13": "text", "idMarca": "number", "IdAlicIva": "number"}


def _split(df: DataFrame, key: str, problems: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    reason = F.lit(None).cast("string")
    for cond, why in reversed(problems):
        reason = F.when(cond, F.lit(why)).otherwise(reason)
    tagged = df.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.where(F.col("_reason").isNotNull()).select(key, SEQ, F.col("_reason").alias("reason"))
    return good, bad


def normalise_products(changes: DataFrame, key: str = "ID_Producto") -> tuple[DataFrame, DataFrame]:
    """Product defaults; name and provider are required (NOT NULL)."""
    cols = []
    for c in PRODUCT_FIELDS:
        v = F.col(c)
        if c in PRODUCT_NUMBER_DEFAULTS:
            v = or_default_number(v, PRODUCT_NUMBER_DEFAULTS[c])
        elif c in PRODUCT_TEXT_DEFAULTS:
            v = or_default_text(v, PRODUCT_TEXT_DEFAULTS[c])
        elif c in PRODUCT_NULL_IF_FALSY:
            falsy = falsy_text(v) if PRODUCT_NULL_IF_FALSY[c] == "text" else falsy_number(v)
            v = F.when(falsy, F.lit(None)).otherwise(v)
        elif c == "PermiteDescuento":
            v = F.coalesce(v, F.lit(True))  # an explicit false stays false
        cols.append(v.alias(c))
    norm = changes.select(key, SEQ, *cols)
    return _split(norm, key, [(F.col("Descripcion").isNull(), "missing_name"),
                              (F.col("ID_Proveedor").isNull(), "missing_provider")])


CLIENT_TEXT = ["Apellido", "RazonSocial", "Direccion", "Numero", "Telefono", "CUIT", "correo"]
CLIENT_IDS = ["ID_Barrio", "ID_Localidad", "ID_Zona", "id_condicion"]
CLIENT_FIELDS = ["Nombre", *CLIENT_TEXT, *CLIENT_IDS]


def normalise_clients(changes: DataFrame, as_of=None, insert: bool = False,
                      key: str = "ID_Cliente") -> DataFrame:
    """Blank text for missing fields, NULL for missing ids; an insert also
    gets empty extra fields, the sign-up date and state 'ACTIVO'."""
    cols = [F.col("Nombre")]
    cols += [or_default_text(F.col(c), "").alias(c) for c in CLIENT_TEXT]
    cols += [F.when(falsy_number(F.col(c)), F.lit(None)).otherwise(F.col(c)).cast("int").alias(c) for c in CLIENT_IDS]
    if insert:
        cols += [F.lit("").alias("IngresosBrutos"), F.lit("").alias("CodigoPostal"), F.lit("").alias("sitioweb"),
                 ts(as_of).alias("FechaAlta"), F.lit("ACTIVO").alias("Estado")]
    return changes.select(key, SEQ, *cols)


PROVIDER_TEXT = ["Direccion", "Numero", "Telefono", "CUIT", "Correo"]
PROVIDER_IDS = ["ID_Condicion", "Barrio", "Localidad"]
PROVIDER_FIELDS = ["RazonSocial", *PROVIDER_TEXT, *PROVIDER_IDS]


def normalise_providers(changes: DataFrame, insert: bool = False, key: str = "ID_Proveedor") -> DataFrame:
    """The same pattern; an insert also gets five blank fields and 'ACTIVO'."""
    cols = [F.col("RazonSocial")]
    cols += [or_default_text(F.col(c), "").alias(c) for c in PROVIDER_TEXT]
    cols += [F.when(falsy_number(F.col(c)), F.lit(None)).otherwise(F.col(c)).cast("int").alias(c)
             for c in PROVIDER_IDS]
    if insert:
        cols += [F.lit("").alias(c) for c in ("CodigoPostal", "SitioWeb", "Fax", "IB", "NroCuenta")]
        cols += [F.lit("ACTIVO").alias("Estado")]
    return changes.select(key, SEQ, *cols)


def normalise_brands(changes: DataFrame, key: str = "Id_Marca") -> tuple[DataFrame, DataFrame]:
    """A description is required (null or blank is rejected)."""
    return _split(changes.select(key, SEQ, "Mrc_Descripcion"), key,
                  [(falsy_text(F.col("Mrc_Descripcion")), "missing_description")])


def normalise_categories(changes: DataFrame, key: str = "ID_Rubro") -> tuple[DataFrame, DataFrame]:
    """No check in the handler; the column is NOT NULL, so NULL is rejected."""
    return _split(changes.select(key, SEQ, "Descripcion"), key,
                  [(F.col("Descripcion").isNull(), "not_null")])


DRIVER_OPTIONAL = ["DNI", "Telefono", "Direccion", "Email", "Observaciones", "LicenciaConducir"]
DRIVER_FIELDS = ["Nombre", "Apellido", *DRIVER_OPTIONAL, "FechaIngreso", "Estado", "VencimientoLicencia"]


def normalise_drivers(changes: DataFrame, as_of, insert: bool, key: str = "ID_Repartidor") -> tuple[DataFrame, DataFrame]:
    """Names required on insert (blank counts as missing) and NOT NULL on
    update; hire date defaults to now on insert only; state 'Activo';
    an update stamps ``UpdatedAt``, an insert both time stamps."""
    cols = [F.col("Nombre"), F.col("Apellido")]
    cols += [F.when(falsy_text(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c) for c in DRIVER_OPTIONAL]
    hire = F.coalesce(F.col("FechaIngreso"), ts(as_of)) if insert else F.col("FechaIngreso")
    cols += [hire.alias("FechaIngreso"), or_default_text(F.col("Estado"), "Activo").alias("Estado"),
             F.col("VencimientoLicencia")]
    if insert:
        cols += [ts(as_of).alias("CreatedAt"), ts(as_of).alias("UpdatedAt")]
    norm = changes.select(key, SEQ, *cols)
    if insert:
        rules = [(falsy_text(F.col("Nombre")) | falsy_text(F.col("Apellido")), "missing_name")]
    else:
        rules = [(F.col("Nombre").isNull() | F.col("Apellido").isNull(), "not_null")]
    return _split(norm, key, rules)


# ---- W1-W7 as one log ----------------------------------------------------------
OPS = ("insert", "replace", "partial", "delete")


def apply_change_log(base: DataFrame, log: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Inserts (W1 with a given key, W7), full replacements (W2), partial updates (W3) and
    deletes (W4) of one table, in ``change_seq`` order. -> (snapshot, rejects).

    ``log``: key, change_seq, op (one of ``OPS``) and ``columns``. An insert of a key that is
    there, and any other change of one that is not, is rejected; so is a partial update
    without a field, a change without a key and one of another op. Changes of a key that
    share a ``change_seq`` apply in the order of ``OPS``. A new row's other columns are NULL.

    Whether a key is there when a change arrives follows from the last insert or delete
    before it alone, accepted or not; a column then holds what the last accepted change
    that sets it gave. So nothing is replayed: one look back per change (keys with very
    many changes are range-split), then one grouped maximum per column with map-side
    combining, joined to the table."""
    op = F.array_position(F.array(*[F.lit(o) for o in OPS]), F.col("op"))
    supplied = F.lit(False)
    for c in columns:
        supplied = supplied | F.col(c).isNotNull()
    wrong = (F.when(F.col(key).isNull(), F.lit("missing_key")).when(F.coalesce(op, F.lit(0)) == 0, F.lit("unknown_op"))
             .when((F.col("op") == "partial") & ~supplied, F.lit("nothing_to_update")))
    rows = log.select(key, SEQ, "op", *columns).withColumns({"_wrong": wrong, "_code": op - 1})
    usable = rows.where(F.col("_wrong").isNull()).withColumn("_o", -(F.col(SEQ) * 4 + F.col("_code")))
    usable = reliable_checkpoint(usable.drop("_wrong"))
    hot = hot_keys(usable, [key]) if may_have_hot_groups(base.sparkSession, usable.count()) else None
    # backwards in time: the next hit is the last insert or delete before
    seen = following(usable, [key], "_o", {"_last": F.col("op").isin("insert", "delete")}, hot)
    there = base.select(F.col(key), F.lit(True).alias("_there"))
    seen = seen.join(there, key, "left")
    exists = F.when(F.col("_last").isNull(), F.coalesce("_there", F.lit(False))).otherwise(F.pmod(-F.col("_last"), F.lit(4)) == 0)
    seen = seen.withColumn("_ok", exists == (F.col("op") != "insert"))
    done, at = F.col("_ok"), -F.col("_o")
    sets = {c: done & (F.col("op").isin("insert", "replace") | ((F.col("op") == "partial") & F.col(c).isNotNull())) for c in columns}
    last = seen.groupBy(key).agg(
        F.max_by(F.col("op") == "insert", F.when(F.col("op").isin("insert", "delete") & done, at)).alias("_stays"),
        F.max(F.when(done & (F.col("op") == "insert"), F.lit(True))).alias("_new"),
        *[F.max_by(F.struct(F.col(c)), F.when(sets[c], at)).alias(f"_v_{c}") for c in columns])
    j = base.withColumn("_there", F.lit(True)).join(last, key, "full")
    stays = F.coalesce(F.col("_stays"), F.col("_there"), F.lit(False))
    out = [F.col(key) if c == key
           else F.when(F.col(f"_v_{c}").isNotNull(), F.col(f"_v_{c}")[c]).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c) if c in columns
           else F.when(F.col("_new"), F.lit(None)).otherwise(F.col(c)).alias(c) for c in base.columns]
    rejects = (_reject(rows.where(F.col("_wrong").isNotNull()), key, F.col("_wrong"))
               .unionByName(_reject(seen.where(~done), key, F.when(F.col("op") == "insert", F.lit("exists")).otherwise(F.lit("not_found")))))
    return j.where(stays).select(*out), rejects

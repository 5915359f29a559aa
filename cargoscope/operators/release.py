"""Declaration extracts -> wide release records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.functions.cleaning import PRICE_KINDS, joined_lines, price_kind
from cargoscope.operators.keys import KeyBitmap, fill_down_up, keep_first
from cargoscope.session import BROADCAST_ROW_LIMIT, materialise, small_side
from cargoscope.sources.schemas import (
    DECLARATION_KEYS,
    EXTRACTS,
    GROUP_KEYS,
    INVOICE_KEYS,
    ITEM_KEYS,
)

#: Written stages hold repeated key texts: this codec writes a third less than the session's.
STAGE_CODEC = "zstd"
#: Entity ids that fit a condition of the plan.
LITERAL_IDS = 10_000
# One released record per item of a client submission.
RECORD_KEYS = ["clnt_sply_req_id", "cmrc_invc_nbr", "gagi_nbr", "gds_itm_nbr"]
# One item of a declaration, whatever its version.
ITEM = ["drv_req_nbr", "cmrc_invc_nbr", "gagi_nbr", "gds_itm_nbr"]
PARTY_VALUES = [
    "rltd_pty_nm",
    "addr",
    "cty_nm",
    "pstl_zip_cde",
    "prov_st_cde",
    "cntry_cde",
    "pty_id",
]
NAME_LINES = ["rltd_pty_nm_ln1", "rltd_pty_nm_ln2", "rltd_pty_nm_ln3"]
ADDRESS_LINES = ["addr_ln1", "addr_ln2", "addr_ln3"]


def in_list(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of listed entities. Pass ``small_side(ids)`` to keep the rows in place if the list is short.

    A list of up to ``LITERAL_IDS`` ids becomes a condition: unlike a join, it goes below joins and
    aggregates of the table, so that other entities' rows are dropped in the scan.
    """
    if df.schema[column].dataType == ids.schema[0].dataType:
        found = ids.limit(LITERAL_IDS + 1).collect()
        if len(found) <= LITERAL_IDS:
            return df.where(F.col(column).isin([r[0] for r in found]))
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def project(df: DataFrame, keys, payload) -> DataFrame:
    """Keys and payload, as far as the table has them."""
    return df.select([c for c in (*keys, *payload) if c in df.columns])


def extract(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """One extract, restricted to listed entities before anything else touches it."""
    keys, payload = EXTRACTS[name]
    return project(in_list(df, ids, "ax_clnt_nbr"), keys, payload)


def extract_root(df: DataFrame, ids: DataFrame, first_day, last_day, office: str) -> DataFrame:
    """Root records of listed entities, filed within a day range at one office."""
    day = F.to_date("audt_ins_tstmp")
    kept = df.where(
        day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
        & (F.col("so_id") == office)
    )
    return extract(kept, ids, "root")


def release_assembly(x: dict[str, DataFrame]) -> DataFrame:
    """Every extract left-joined onto the goods lines at its own key level.

    All rows are dealt by declaration once: every finer key lies within one, so what the joins fan out is
    not shuffled again.
    """
    steps = [
        ("item_description", ITEM_KEYS),
        ("package_count", ITEM_KEYS),
        ("price", ITEM_KEYS),
        ("package_qty", GROUP_KEYS),
        ("invoice", INVOICE_KEYS),
        ("invoice_country", INVOICE_KEYS),
        ("party", DECLARATION_KEYS),
        ("shipment", DECLARATION_KEYS),
    ]
    goods = x["goods_source"]
    _join_in_place(goods)
    out = goods.repartition(*DECLARATION_KEYS)
    for name, keys in steps:
        out = out.join(x[name], list(keys), "left")
    return out


def release_root_join(assembled: DataFrame, root: DataFrame) -> DataFrame:
    """Assembled goods of every root declaration; roots without goods stay."""
    return assembled.join(root, list(DECLARATION_KEYS), "right")


def price_type_recode(df: DataFrame) -> DataFrame:
    return df.withColumn("price_tcde", price_kind(F.col("price_tcde")))


def trim_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns})


def concat_name_address(df: DataFrame) -> DataFrame:
    """Three name lines and three address lines become one name and one address."""
    return df.withColumns(
        {
            "rltd_pty_nm": joined_lines(*[F.col(c) for c in NAME_LINES]),
            "addr": joined_lines(*[F.col(c) for c in ADDRESS_LINES]),
        }
    ).drop(*NAME_LINES, *ADDRESS_LINES)


def party_description_join(df: DataFrame, codes: DataFrame) -> DataFrame:
    """The party code replaced by its description; an unknown code becomes null."""
    lookup = codes.select(F.col("pty_tcde").alias("_code"), F.col("description").alias("_text"))
    return (
        df.withColumn("pty_tcde", F.trim("pty_tcde"))
        .join(small_side(lookup), F.col("pty_tcde") == F.col("_code"), "left")
        .withColumn("pty_tcde", F.col("_text"))
        .drop("_code", "_text")
    )


def pivot_price_type(df: DataFrame, keys: list[str]) -> DataFrame:
    """Price rows -> ``invoice_total`` and ``invoice_ppu``; repeated kinds keep the lowest price."""
    wide = df.groupBy(*keys).pivot("price_tcde", list(PRICE_KINDS)).agg(F.min("price_val"))
    return wide.withColumnsRenamed({k: f"invoice_{k.lower()}" for k in PRICE_KINDS})


def party_column(value: str, description: str) -> str:
    return f"{value}_{description.lower().replace(' ', '_')}"


def pivot_party_type(df: DataFrame, keys: list[str], descriptions: list[str]) -> DataFrame:
    """Party rows -> seven columns per listed description, first non-null by party code.

    The parties of one description first shrink to one row; the pivot then only places values.
    """
    position = F.struct("pty_code", "pty_id")
    one = df.groupBy(*keys, "pty_tcde").agg(
        *[_first_known(F.col(v), F.lit(True), position).alias(v) for v in PARTY_VALUES]
    )
    return one.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("pty_tcde") == d, F.col(v))).alias(party_column(v, d))
            for v in PARTY_VALUES
            for d in descriptions
        ]
    )


def _first_known(value: Column, condition: Column, position: Column) -> Column:
    """Aggregate: the first non-null value meeting a condition, in an explicit order."""
    return F.min_by(value, F.when(condition & value.isNotNull(), position))


def _first_rows(df: DataFrame, keys, order: list[str], filled: list[str], plain: list[str]) -> DataFrame:
    """One row per key: the first row, with ``filled`` columns taken from the first row having one."""
    position = F.struct(*order)
    first = [F.min_by(F.struct(*plain), position).alias("_row")] if plain else []
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in filled]
    rows = df.groupBy(*keys).agg(*first, *known)
    return rows.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in plain], *filled)


def wide_prices(price: DataFrame) -> DataFrame:
    """Currency of the first price row and both price kinds, one row per item."""
    order = ["price_tcde", "price_val"]
    # Dealt once, rows of a code and codes of an item meet in place.
    one_per_code = keep_first(_dealt(price, ITEM_KEYS), [*ITEM_KEYS, "price_tcde"], [F.asc(c) for c in order])
    coded = one_per_code.withColumn("_kind", price_kind(F.col("price_tcde")))
    position = F.struct(*order)
    return coded.groupBy(*ITEM_KEYS).agg(
        F.min_by("price_crncy_cde", position).alias("price_crncy_cde"),
        *[
            _first_known(F.col("price_val"), F.col("_kind") == k, position).alias(
                f"invoice_{k.lower()}"
            )
            for k in PRICE_KINDS
        ],
    )


def wide_parties(party: DataFrame, codes: DataFrame, descriptions: list[str]) -> DataFrame:
    """One row per declaration with its parties side by side."""
    dealt = _dealt(concat_name_address(party), DECLARATION_KEYS)
    one_per_code = keep_first(dealt, [*DECLARATION_KEYS, "pty_tcde"], [F.asc("pty_id")])
    described = party_description_join(
        one_per_code.withColumn("pty_code", F.col("pty_tcde")), codes
    )
    return pivot_party_type(described, list(DECLARATION_KEYS), descriptions)


#: Columns that a submission's first declaration takes from the next one that has them.
PRICE_COLUMNS = ["invoice_total", "invoice_ppu"]


#: Extracts that add plain columns to a record: key, order of a key's rows, columns taken from the first row that has one.
_SIDES = {
    "item_description": (ITEM_KEYS, ["itm_char_sqnbr", "itm_desc_txt"], ["class_cde", "itm_desc_txt"]),
    "package_count": (ITEM_KEYS, ["msr_unit_tcde", "unit_cnt"], []),
    "package_qty": (GROUP_KEYS, ["un_pkg_tcde", "qty"], []),
    "invoice": (INVOICE_KEYS, ["invc_tamt"], []),
    "invoice_country": (INVOICE_KEYS, ["dprt_dt", "invc_cntry_cde"], ["invc_cntry_cde", "invc_st_cde", "dprt_dt"]),
    "shipment": (DECLARATION_KEYS, ["ttl_trans_val"], []),
}


def wanted_declarations(x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The extracts without rows of declarations that the root does not hold.

    The list of declarations is checked for its size: a short one is sent to the scans, so that nothing
    else of an extract is aggregated or moved; of a long one a bitmap is sent, which lets a few others
    pass. These are left to the joins with the root.
    """
    keys = list(DECLARATION_KEYS)
    root = x["root"].select(*keys)
    listed = materialise(root.distinct(), STAGE_CODEC)
    if listed.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        return {
            name: df if name == "root" else df.join(F.broadcast(listed), keys, "left_semi") for name, df in x.items()
        }
    bitmap = KeyBitmap.of(listed, keys)

    def marked(name: str, df: DataFrame) -> bool:
        # Hashes of a number depend on its type.
        return name != "root" and [df.schema[k].dataType for k in keys] == [f.dataType for f in root.schema]

    return {
        name: bitmap.marked(df, keys, "_listed").where("_listed").drop("_listed") if marked(name, df) else df
        for name, df in x.items()
    }


POSITION = [*DECLARATION_KEYS, "cntry_orig_cde", "ste_orig_cde"]


def declared_records(x: dict[str, DataFrame]) -> DataFrame:
    """Bare rows of the latest versions, one per record and declaration that holds it, with goods and root columns.

    Versions of a declaration share its request number: dealt by that number once, goods and root meet, and the
    newest version and the first row of each record are found in place.
    """
    _join_in_place(x["root"])
    marked = x["goods_source"].withColumn("_goods", F.lit(True)).dropna(subset=list(DECLARATION_KEYS))
    goods = marked.repartition("drv_req_nbr").join(
        x["root"].repartition("drv_req_nbr"), list(DECLARATION_KEYS), "right"
    )
    item = Window.partitionBy(*ITEM)
    named = F.count("clnt_sply_req_id").over(item)
    # Only items that name their submission in some rows and not in others have anything to fill.
    seen = goods.withColumns(
        {
            "_newest": F.max("req_vers_nbr").over(item),
            "_partly": (named > 0) & (named < F.count(F.lit(1)).over(item)),
        }
    )
    newest = seen.where(F.col("req_vers_nbr").eqNullSafe(F.col("_newest"))).drop("_newest")
    other = [c for c in DECLARATION_KEYS if c not in RECORD_KEYS]
    # Rows to fill stay apart until they are filled: each may pass its submission on.
    apart = newest.withColumn("_own", F.when(F.col("_partly"), F.struct("cntry_orig_cde", "ste_orig_cde")))
    order = [F.asc(c) for c in POSITION]
    first = materialise(keep_first(apart, [*RECORD_KEYS, *other, "_own"], order).drop("_own"), STAGE_CODEC)
    rest = [c for c in DECLARATION_KEYS if c not in ITEM]
    partly = fill_down_up(
        first.where("_partly"), ITEM, rest, ["cntry_orig_cde", "ste_orig_cde"], ["clnt_sply_req_id"]
    )
    filled = materialise(keep_first(partly, [*RECORD_KEYS, *other], order), STAGE_CODEC)
    return first.where("NOT _partly").unionByName(filled).drop("_partly")


def _join_in_place(df: DataFrame) -> None:
    """Joins on more keys than the rows are dealt by leave them where they are."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _dealt(df: DataFrame, keys) -> DataFrame:
    """Rows with a whole key, dealt by declaration: rows without one join nothing, finer keys lie within."""
    return df.dropna(subset=list(keys)).repartition(*DECLARATION_KEYS)


def release_wide(
    x: dict[str, DataFrame], codes: DataFrame, descriptions: list[str], columns: list[str] | None = None
) -> DataFrame:
    """One wide record per item of each client submission, from its latest version.

    Parties, prices and repeated rows fan out against each other when joined first and reshaped
    afterwards. Here the latest version is found on bare keys; rows and extracts are dealt by
    declaration once, where every extract is reduced to one row at its own key level and joined in place.
    A submission may hold several declarations: prices and parties that its first one lacks come from
    the next that has them. Only records with several declarations are shuffled for that.

    ``columns`` names what is read of the result; extracts that add none of these are never touched.
    """
    x = wanted_declarations(x)
    if columns is not None:
        unread = [c for c in x["root"].columns if c not in (*DECLARATION_KEYS, *RECORD_KEYS, *columns)]
        x["root"] = x["root"].drop(*unread)
    rows = declared_records(x)
    read = set(columns) if columns is not None else None

    def asked(names: list[str]) -> list[str]:
        return [c for c in names if read is None or c in read]

    # A record marked in error, by a hash it shares, goes the longer way to the same row.
    hashed = rows.withColumn("_record", F.hash(*RECORD_KEYS))
    several = hashed.groupBy("_record").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    repeated = KeyBitmap.of(materialise(several, STAGE_CODEC), ["_record"])
    out = repeated.marked(hashed, ["_record"], "_several").drop("_record").repartition(*DECLARATION_KEYS)
    parties = {party_column(v, d): d for v in PARTY_VALUES for d in descriptions}
    prices_read, parties_read = asked(PRICE_COLUMNS), asked(list(parties))
    for name, (keys, order, known) in _SIDES.items():
        if taken := asked([c for c in x[name].columns if c not in keys]):
            dealt = _dealt(x[name], keys)
            side = _first_rows(dealt, keys, order, [c for c in taken if c in known], [c for c in taken if c not in known])
            joined = out.join(side, list(keys), "left")
            # A root without goods gets nothing but its own columns.
            out = joined.withColumns({c: F.when(F.col("_goods"), F.col(c)) for c in taken} if keys == DECLARATION_KEYS else {})
    if priced := [*asked(["price_crncy_cde"]), *prices_read]:
        out = out.join(wide_prices(x["price"]).select(*ITEM_KEYS, *priced), list(ITEM_KEYS), "left")
    if parties_read:
        described = [d for d in descriptions if d in {parties[c] for c in parties_read}]
        # Not for a root without goods: its mark is null and joins nothing.
        party = wide_parties(x["party"], codes, described).withColumn("_goods", F.lit(True))
        keys = [*DECLARATION_KEYS, "_goods"]
        out = out.join(party.select(*keys, *parties_read), keys, "left")
    if parties_read:
        # Wide rows are written rather than joined for both branches below.
        out = materialise(out, STAGE_CODEC)
    merged = [*prices_read, *parties_read]
    plain = [c for c in out.columns if c not in (*RECORD_KEYS, *merged, "_goods", "_several")]
    chosen = [*RECORD_KEYS, *plain, *merged]
    together = _first_rows(out.where("_several"), RECORD_KEYS, POSITION, merged, plain)
    out = out.where("NOT _several").select(*chosen).unionByName(together)
    trimmed = trim_columns(out, [c for c in ("clnt_sply_req_id", "class_cde") if c in out.columns])
    return trimmed if columns is None else trimmed.select(*columns)

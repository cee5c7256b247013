"""Licences from their scraped lists to areas: cleaning, the active ones, and the locality of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import capitalize, fold, island_district, normalize_postcode, without_suffix
from tessera.operators.relational import latest_by, shuffled

#: Areas are broadcast while there are no more of them than this.
BROADCAST_AREAS = 100_000

#: Columns of a scraped list, what they are called here, and how they are read. Fixed values, in order.
RAW_COLUMNS = (
    ("etl_timestamp", "etl_timestamp", "as is"),
    ("Nº de registo", "registration_number", "text"),
    ("Data do registo", "registration_date", "date"),
    ("Nome do Alojamento", "lodging_name", "name"),
    ("Imóvel posterior a 1951", "is_building_post_1951", "yes or no"),
    ("Data Abertura Público", "public_opening_date", "date"),
    ("modalidade", "house_type", "as is"),
    ("Nº Camas", "beds", "int"),
    ("Nº Utentes", "max_guests", "int"),
    ("Nº Quartos", "rooms", "int"),
    ("Localização (Endereço)", "address", "text"),
    ("Localização (Código postal)", "postal_code", "text"),
    ("Localização (Localidade)", "locality", "name"),
    ("Localização (Freguesia)", "parish", "name"),
    ("Localização (Concelho)", "municipality", "name"),
    ("Localização (Distrito)", "district", "name"),
    ("NUTT II", "region_nuts_ii", "text"),
    ("Nome do Titular da Exploração", "operator_name", "text"),
    ("Titular Qualidade", "operator_quality", "text"),
    ("contribuinte", "tax_id", "bigint"),
    ("Titular Tipo", "operator_type", "text"),
    ("Titular País", "operator_country", "text"),
    ("Contacto Telefone", "phone", "text"),
    ("Contacto Fax", "fax", "text"),
    ("Contacto Telemovel", "mobile", "text"),
    ("Contacto Email", "email", "text"),
)


def _read(raw: str, kind: str) -> Column:
    column = F.col(f"`{raw}`")
    if kind == "as is":
        return column
    text = F.trim(column.cast("string"))
    if kind == "name":
        return capitalize(text)
    if kind == "yes or no":
        return F.when(text == "S", True).when(text == "N", False)
    return text if kind == "text" else text.try_cast(kind)


def stage_licences(raw: DataFrame) -> DataFrame:
    """The latest row of each licence, with names in capitals, codes and districts put right, and al_id from its number.

    What is no date or number becomes null instead of failing the job. Of rows with one time stamp the greatest number and
    address are taken; rows without a licence number are one licence."""
    raw_names = {name: (column, kind) for column, name, kind in RAW_COLUMNS}
    read = lambda name: _read(*raw_names[name]).alias(f"__{name}")
    number = F.col("`Nº de registo`").cast("string")
    al_id = F.when(number.endswith("/AL"), number.substr(F.lit(1), F.length(number) - 3)).otherwise(number)
    # Only what the choice of a row needs is read of all rows, the rest of the chosen ones.
    chosen = latest_by(raw.select("*", al_id.alias("__al_id"), read("registration_number"), read("address")), ["__al_id"], "etl_timestamp", ["__registration_number", "__address"])
    rows = chosen.select(F.col("__al_id").alias("al_id"), *[_read(column, kind).alias(name) for column, name, kind in RAW_COLUMNS])
    return rows.withColumns({
        "postal_code": normalize_postcode(F.col("postal_code")),
        "municipality": without_suffix(F.col("municipality")),
        "district": island_district(F.col("district")),
    })


def active_licences(staged: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Licences with is_active (seen in the last snapshot), closed_month (the last snapshot, for those that aren't), and the
    position and the code that stands for theirs (postcodes: postcode, lng, lat, real_postcode)."""
    last = staged.agg(F.max("etl_timestamp").alias("last"))  # one row
    columns = (
        "al_id", "registration_number", "registration_date", F.col("lodging_name").alias("name"), "is_building_post_1951", F.col("public_opening_date").alias("opening_date"), "house_type",
        "beds", "max_guests", "rooms", "address", "postal_code", "locality", "municipality", "district", "operator_name", "operator_quality", "operator_type", "email",
    )
    seen = F.col("etl_timestamp") == F.col("last")
    rows = staged.crossJoin(F.broadcast(last)).select(*columns, seen.alias("is_active"), F.when(~seen, F.col("last")).alias("closed_month"))
    at = postcodes.select(F.col("postcode").alias("__code"), "lng", "lat", "real_postcode")
    return rows.join(shuffled(at), F.col("postal_code") == F.col("__code"), "left").drop("__code")


def area_chain(areas: DataFrame) -> DataFrame:
    """Localities with the names and ids of the municipality and region above them."""
    level = lambda kind, name: areas.where(F.col("admin_type") == kind).select(F.col("osm_id").alias(f"{name}_osm_id"), F.col("name").alias(f"{name}_name"), F.col("parent_id").alias(f"{name}_parent"))
    low, middle, high = level("locality", "locality"), level("municipality", "municipality"), level("region", "region")
    joined = low.join(middle, low.locality_parent == middle.municipality_osm_id, "left").join(high, middle.municipality_parent == high.region_osm_id, "left")
    return joined.drop("locality_parent", "municipality_parent", "region_parent")


def map_licences(licences: DataFrame, areas: DataFrame, postcodes: DataFrame, similar: DataFrame, code_col: str = "real_postcode", excluded_regions: tuple[int, ...] = (1629146,)) -> DataFrame:
    """Licences with their locality, municipality and region; those without a region, or in an excluded one, go.

    A locality is found by its name and those above it, accents and case apart; else by the code (postcodes: postcode,
    locality_id), else by the code that is most like it (similar: postcode, locality_osm_id). A name that two localities of
    one municipality share stands for the one with the smaller id."""
    chain = area_chain(areas)
    few = F.broadcast if areas.count() <= BROADCAST_AREAS else shuffled
    keys = [fold(F.col(f"{c}_name")).alias(f"__{c}") for c in ("locality", "municipality", "region")]
    named = chain.select(*keys, "locality_osm_id").groupBy("__locality", "__municipality", "__region").agg(F.min("locality_osm_id").alias("__by_name"))
    on = [fold(F.col(c)) == F.col(k) for c, k in (("locality", "__locality"), ("municipality", "__municipality"), ("district", "__region"))]
    coded = postcodes.select(F.col("postcode").alias("__code"), F.col("locality_id").alias("__by_code"))
    alike = similar.select(F.col("postcode").alias("__like"), F.col("locality_osm_id").alias("__by_like"))
    known = coded.join(shuffled(alike), F.col("__code") == F.col("__like"), "full").select(F.coalesce("__code", "__like").alias("__code"), F.coalesce("__by_code", "__by_like").alias("__by_code"))
    rows = licences.join(few(named), reduce(Column.__and__, on), "left")
    # Codes are asked for by those without a name only, and who has neither goes anyway.
    by_code = rows.where(F.col("__by_name").isNull() & F.col(code_col).isNotNull()).join(shuffled(known.where("__by_code IS NOT NULL")), F.col(code_col) == F.col("__code"))
    own = [F.col(c) for c in licences.columns]
    rows = rows.where("__by_name IS NOT NULL").select(*own, F.col("__by_name").alias("__id")).unionByName(by_code.select(*own, F.col("__by_code").alias("__id")))
    found = rows.join(few(chain), F.col("__id") == F.col("locality_osm_id"), "left").where(F.col("region_osm_id").isNotNull() & ~F.col("region_osm_id").isin(*excluded_regions))
    return found.select(*[F.col(c) for c in licences.columns], *chain.columns)

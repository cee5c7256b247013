"""From scraped lists to mapped licences over the tables at hand, with the SQL that each step must agree with.

The raw tables (a list with two snapshots, bulk codes, looked-up codes, localities' shapes) are made by SQL that both
engines read; everything after them is the library's operators here, and plain SQL there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import capitalize
from tessera.operators import analytics, postcodes, staging
from tessera.operators.relational import shuffled
from tessera.plans import checks, marts
from tessera.plans.domain import DOMAIN_SQL, table
from tessera.plans.store import stored

_CODE = "lpad(CAST(1000 + {k} * 37 % 8999 AS STRING), 4, '0') || '-' || lpad(CAST({k} * 17 % 1000 AS STRING), 3, '0')"
_OWN_CODE = _CODE.format(k="c_custkey")
#: Raw column -> its value, in SQL of both engines.
_RAW = {
    "Nº de registo": "CAST(o_orderkey AS STRING) || '/AL'",
    "Data do registo": "' ' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) || ' '",
    "Nome do Alojamento": "'CASA ' || c_mktsegment || '  do (' || n_name || ')'",
    "Imóvel posterior a 1951": "CASE o_orderstatus WHEN 'F' THEN 'S ' WHEN 'O' THEN ' N' END",
    "Data Abertura Público": "CASE WHEN o_orderstatus = 'P' THEN 'sem data' ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) END",
    "modalidade": "o_orderpriority",
    "Nº Camas": "' ' || CAST(o_orderkey % 11 AS STRING)",
    "Nº Utentes": "CAST(o_orderkey % 9 + seen AS STRING)",
    "Nº Quartos": "CAST(o_orderkey % 5 AS STRING)",
    "Localização (Endereço)": "c_name",
    "Localização (Código postal)": f"""CASE o_orderpriority WHEN '1-URGENT' THEN ' ' || {_OWN_CODE} || ' ' WHEN '2-HIGH' THEN substr({_OWN_CODE}, 1, 4)
      WHEN '3-MEDIUM' THEN {_OWN_CODE} || ',' || {_OWN_CODE} WHEN '4-NOT SPECIFIED' THEN NULL ELSE {_OWN_CODE} END""",
    "Localização (Localidade)": "CASE o_orderpriority WHEN '5-LOW' THEN 'LUGAR DESCONHECIDO' ELSE replace(c_mktsegment, 'U', 'Ú') END",
    "Localização (Freguesia)": "lower(c_mktsegment)",
    "Localização (Concelho)": "CASE o_orderpriority WHEN '2-HIGH' THEN n_name || ' (' || r_name || ')' ELSE n_name END",
    "Localização (Distrito)": "r_name",
    "NUTT II": "r_name",
    "Nome do Titular da Exploração": "c_name",
    "Titular Qualidade": "o_orderstatus",
    "contribuinte": "CAST(c_custkey AS STRING)",
    "Titular Tipo": "c_mktsegment",
    "Titular País": "n_name",
    "Contacto Telefone": "CAST(c_custkey * 7 AS STRING)",
    "Contacto Fax": "CAST(NULL AS STRING)",
    "Contacto Telemovel": "CAST(c_custkey * 3 AS STRING)",
    "Contacto Email": "lower(c_name)",
}
_JOINED = """{orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
  JOIN (SELECT 1 AS seen, TIMESTAMP '2001-08-01 06:00:00' AS etl_timestamp UNION ALL SELECT 2, TIMESTAMP '2001-09-01 06:00:00') s ON seen = 1 OR o_orderstatus <> 'F'"""
_PLACE = """SELECT p_partkey, p_size, (n_nationkey % 5) + CAST(k % 97 AS DOUBLE) / 97 AS lng, CAST(n_nationkey - n_nationkey % 5 AS DOUBLE) / 5 + CAST(k % 89 AS DOUBLE) / 89 AS lat,
    r_name AS district, n_name AS municipality,
    CASE p_partkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS locality
  FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN p_partkey - p_partkey % 2 ELSE p_partkey END AS k FROM {part}) p
  JOIN {nation} n ON k % 25 = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey"""
_BULK = f"SELECT {_CODE.format(k='p_partkey')} AS postcode, district, municipality, locality, lng, lat FROM ({_PLACE}) x WHERE p_size <= 40"
_API = f"""SELECT {_CODE.format(k='p_partkey')} AS postcode, CASE WHEN p_size % 7 = 0 THEN {_CODE.format(k='(p_partkey + 1)')} ELSE {_CODE.format(k='p_partkey')} END AS query_postcode,
  district, municipality, CASE WHEN p_size <> 30 THEN locality END AS locality, lng + 0.001e0 AS lng, lat + 0.001e0 AS lat FROM ({_PLACE}) x WHERE p_size > 25"""
_TABLES = ("orders", "customer", "nation", "region", "part")


def _sql(spark, sf_dir, text):
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in text})


def raw_list(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT etl_timestamp, {', '.join(f'{v} AS `{k}`' for k, v in _RAW.items())} FROM {_JOINED}")


def _codes(spark, sf_dir, text):
    named = {c: capitalize(F.col(c)) for c in ("district", "municipality", "locality")}
    return _sql(spark, sf_dir, text).withColumns(named)


def bulk_codes(spark, sf_dir):
    return stored(spark, "bulk-codes", sf_dir, lambda: _codes(spark, sf_dir, _BULK))


def looked_up(spark, sf_dir):
    return stored(spark, "looked-up-codes", sf_dir, lambda: _codes(spark, sf_dir, _API))


def locality_shapes(spark, sf_dir):
    """Each locality an upright strip, a fifth of its nation's square."""
    i = F.col("osm_id")
    nation, part = F.floor((i - 10000) / 10), i % 10
    x, y = nation % 5, F.floor(nation / 5).cast("double")
    left, right = x + part.cast("double") / 5, x + (part + 1).cast("double") / 5
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.alias("y"))
    ring = F.array(point(left, y), point(right, y), point(right, y + 1), point(left, y + 1))
    return marts.known(spark, sf_dir).where("admin_type = 'locality'").select("osm_id", F.array(ring).alias("polygon"))


CELL = 0.5


def staged_licences(spark, sf_dir):
    """Scraped lists, cleaned, the latest row of each licence."""
    return stored(spark, "staged-licences", sf_dir, lambda: staging.stage_licences(raw_list(spark, sf_dir)))


def _used(spark, sf_dir):
    return staged_licences(spark, sf_dir).select(F.col("postal_code").alias("postcode"), "municipality", "district")


def _step(spark, sf_dir):
    return lambda name, build: stored(spark, name, sf_dir, build)


def code_aliases(spark, sf_dir):
    return postcodes.chain_aliases(_used(spark, sf_dir), looked_up(spark, sf_dir), bulk_codes(spark, sf_dir), _step(spark, sf_dir))[0]


def postcode_chain(spark, sf_dir):
    """All codes with a locality and the areas that they lie in; each step is written once."""
    tables = _used(spark, sf_dir), looked_up(spark, sf_dir), bulk_codes(spark, sf_dir), marts.known(spark, sf_dir), locality_shapes(spark, sf_dir)
    return stored(spark, "postcodes", sf_dir, lambda: postcodes.postcode_chain(*tables, CELL, _step(spark, sf_dir)))


def similar_codes(spark, sf_dir):
    build = lambda: postcodes.similar_codes(_used(spark, sf_dir), postcode_chain(spark, sf_dir), marts.known(spark, sf_dir), locality_shapes(spark, sf_dir), CELL)
    return stored(spark, "similar-codes", sf_dir, build)


def duplicate_codes(spark, sf_dir):
    return postcodes.shared_codes(bulk_codes(spark, sf_dir))


def active_licences(spark, sf_dir):
    return stored(spark, "active-licences", sf_dir, lambda: staging.active_licences(staged_licences(spark, sf_dir), postcode_chain(spark, sf_dir)))


def mapped_licences(spark, sf_dir):
    """Licences with their areas: by names, else by code."""
    build = lambda: staging.map_licences(active_licences(spark, sf_dir), marts.known(spark, sf_dir), postcode_chain(spark, sf_dir), similar_codes(spark, sf_dir), excluded_regions=(104,))
    return stored(spark, "mapped-licences", sf_dir, build)


def lost_mapped(spark, sf_dir):
    """Licences that the last snapshot lacks, with the snapshot that lacked them first, and their areas, by their own code."""
    seen = staged_licences(spark, sf_dir)

    def build():
        gone = analytics.lost_licences(seen, "al_id", "etl_timestamp").select(F.col("id").alias("al_id"), "lost_in")
        return seen.select("al_id", "locality", "municipality", "district", "postal_code").join(shuffled(gone), "al_id")

    return staging.map_licences(stored(spark, "lost-licences", sf_dir, build), marts.known(spark, sf_dir), postcode_chain(spark, sf_dir), similar_codes(spark, sf_dir), "postal_code", (104,))


def mapping_checks(spark, sf_dir):
    """The registry's checks over the mapped licences and the codes."""
    al, codes, unmapped = mapped_licences(spark, sf_dir), postcode_chain(spark, sf_dir), active_licences(spark, sf_dir)
    return checks.run_checks({
        "al_unique": checks.not_unique(al, "al_id"),
        "al_unmapped_unique": checks.not_unique(unmapped, "al_id"),
        "postcodes_unique": checks.not_unique(codes, "postcode"),
        "localities_have_one_parent": checks.several_parents(al, "locality_osm_id", "municipality_osm_id"),
        "postcodes_exist": checks.unknown(al.select("postal_code"), "postal_code", codes.select("postcode")),
        "names_near_localities": checks.far_names(unmapped, marts.known(spark, sf_dir)),
    })


def _cap(x: str) -> str:
    return rf"""CASE WHEN {x} IS NULL OR {x} = '' OR NOT regexp_matches({x}, '\p{{L}}') THEN {x} WHEN regexp_matches({x}, '^\P{{L}}*\p{{L}}+$') THEN upper(({x})[1]) || lower(({x})[2:])
  ELSE regexp_replace(array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '\p{{L}}+'), regexp_split_to_array({x}, '\P{{L}}+')),
    lambda p: coalesce(p[1], '') || upper(coalesce(p[2], '')[1]) || lower(coalesce(p[2], '')[2:])), ''), ' {{2,}}', ' ', 'g') END"""


_names = {t: t for t in _TABLES}
_text = lambda c: f'trim("{c}")'
_STAGED = {
    "registration_number": _text("Nº de registo"), "registration_date": f'try_cast({_text("Data do registo")} AS DATE)', "lodging_name": _cap(_text("Nome do Alojamento")),
    "is_building_post_1951": f"""CASE {_text("Imóvel posterior a 1951")} WHEN 'S' THEN true WHEN 'N' THEN false END""", "public_opening_date": f'try_cast({_text("Data Abertura Público")} AS DATE)',
    "house_type": "modalidade", "beds": f'{_text("Nº Camas")}::INTEGER', "max_guests": f'{_text("Nº Utentes")}::INTEGER', "rooms": f'{_text("Nº Quartos")}::INTEGER', "address": _text("Localização (Endereço)"),
    "postal_code": f"""CASE WHEN code IS NULL THEN '0000-000' WHEN regexp_full_match(code, '\\d{{4}}-\\d{{3}}') THEN code WHEN regexp_full_match(code, '\\d{{4}}') THEN code || '-000' WHEN contains(code, ',') THEN code[1:8] END""",
    "locality": _cap(_text("Localização (Localidade)")), "parish": _cap(_text("Localização (Freguesia)")), "municipality": f"""regexp_replace({_cap(_text("Localização (Concelho)"))}, '\\s+\\(.*\\)', '')""",
    "district": _cap(_text("Localização (Distrito)")), "region_nuts_ii": _text("NUTT II"), "operator_name": _text("Nome do Titular da Exploração"), "operator_quality": _text("Titular Qualidade"),
    "tax_id": "contribuinte::BIGINT", "operator_type": _text("Titular Tipo"), "operator_country": _text("Titular País"), "phone": _text("Contacto Telefone"), "fax": _text("Contacto Fax"),
    "mobile": _text("Contacto Telemovel"), "email": _text("Contacto Email"),
}
_number = lambda c: f"try_cast({c}[1:4] || {c}[6:9] AS INTEGER)"
_capped = ", ".join(f"{_cap(c)} AS {c}" for c in ("district", "municipality", "locality"))
_fold = lambda x: f"lower(strip_accents({x}))"
CHAIN_SQL = f"""WITH {DOMAIN_SQL},
raw AS (SELECT etl_timestamp, {', '.join(f'{v} AS "{k}"' for k, v in _RAW.items())} FROM {_JOINED.format(**_names)}),
staged AS (SELECT split_part("Nº de registo", '/AL', 1) AS al_id, etl_timestamp, {', '.join(f'{v} AS {k}' for k, v in _STAGED.items())}
  FROM (SELECT *, {_text("Localização (Código postal)")} AS code FROM raw) QUALIFY etl_timestamp = max(etl_timestamp) OVER (PARTITION BY "Nº de registo")),
bulk AS (SELECT * REPLACE ({_capped}) FROM ({_BULK.format(**_names)})), api AS (SELECT * REPLACE ({_capped}) FROM ({_API.format(**_names)})),
bad_bulk AS (SELECT postcode FROM bulk JOIN (SELECT lng, lat FROM bulk GROUP BY ALL HAVING count(DISTINCT postcode) > 1) USING (lng, lat)),
bad_api AS (SELECT postcode FROM api JOIN (SELECT lng, lat FROM api GROUP BY ALL HAVING count(DISTINCT postcode) > 1) USING (lng, lat)),
good_api AS (SELECT * FROM api WHERE postcode NOT IN (SELECT postcode FROM bad_api)),
clean AS (SELECT postcode, district, municipality, lng, lat FROM good_api UNION SELECT postcode, district, municipality, lng, lat FROM bulk
  WHERE postcode NOT IN (SELECT postcode FROM bad_bulk) AND postcode NOT IN (SELECT postcode FROM good_api)),
missing AS (SELECT postal_code AS postcode, min(municipality) AS municipality, min(district) AS district FROM staged WHERE postal_code NOT IN (SELECT postcode FROM clean) GROUP BY 1),
sought AS (SELECT * FROM missing UNION ALL SELECT postcode, municipality, district FROM api WHERE query_postcode IN (SELECT postcode FROM missing)),
target AS (SELECT postcode AS alias, min(municipality) AS municipality, min(district) AS district, min({_number('postcode')}) AS number FROM clean GROUP BY 1),
every AS (SELECT postcode, lng, lat FROM api UNION SELECT postcode, lng, lat FROM bulk),
options AS (SELECT s.postcode, alias, CASE WHEN s.municipality = t.municipality THEN CASE WHEN s.district = t.district THEN 'district' ELSE 'municipality' END ELSE 'all' END AS correction_type
    FROM sought s JOIN target t ON s.municipality = t.municipality OR s.postcode[1:2] = alias[1:2]
    QUALIFY row_number() OVER (PARTITION BY s.postcode ORDER BY s.municipality <> t.municipality, s.municipality = t.municipality AND s.district <> t.district, abs({_number('s.postcode')} - number), alias) = 1
  UNION ALL SELECT a.postcode, min(b.postcode), 'duplicate' FROM every a JOIN every b ON a.lng = b.lng AND a.lat = b.lat AND a.postcode <> b.postcode GROUP BY a.postcode
  UNION ALL SELECT postcode, query_postcode, 'api' FROM api WHERE postcode <> query_postcode),
aliases AS (SELECT postcode, alias AS alias_postcode, correction_type FROM options QUALIFY row_number() OVER (PARTITION BY postcode ORDER BY correction_type, alias) = 1),
own AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY postcode ORDER BY district, municipality, lng, lat) = 1),
codes AS (SELECT *, true AS is_valid, '_exact' AS correction_type, postcode AS real_postcode FROM own
  UNION ALL SELECT postcode, NULL, NULL, NULL, NULL, false, correction_type, alias_postcode FROM aliases WHERE postcode NOT IN (SELECT postcode FROM own)),
asked AS (SELECT postcode, min(locality) AS locality FROM api WHERE locality IS NOT NULL GROUP BY 1),
placed AS (SELECT c.postcode, locality, coalesce(c.municipality, r.municipality) AS municipality, coalesce(c.lng, r.lng) AS lng, coalesce(c.lat, r.lat) AS lat, c.is_valid, c.correction_type, c.real_postcode, r.lng AS x, r.lat AS y
  FROM codes c JOIN asked USING (postcode) LEFT JOIN codes r ON c.real_postcode = r.postcode),
chain AS (SELECT l.osm_id AS locality_osm_id, l.name AS locality_name, m.osm_id AS municipality_osm_id, m.name AS municipality_name, g.osm_id AS region_osm_id, g.name AS region_name
  FROM areas l JOIN areas m ON l.parent_id = m.osm_id JOIN areas g ON m.parent_id = g.osm_id WHERE l.admin_type = 'locality'),
strip AS (SELECT osm_id, ((osm_id - 10000) // 10) % 5 + (osm_id % 10)::DOUBLE / 5 AS x0, ((osm_id - 10000) // 10) % 5 + (osm_id % 10 + 1)::DOUBLE / 5 AS x1, (osm_id - 10000) // 50 AS y0 FROM areas WHERE admin_type = 'locality'),
postcodes AS (SELECT postcode, chain.locality_name AS locality, chain.locality_osm_id AS locality_id, lng, lat, is_valid, correction_type, real_postcode, municipality_osm_id AS municipality_id, municipality_name,
    region_osm_id AS region_id, region_name, x, y
  FROM (SELECT placed.*, coalesce(n.locality_osm_id, s.osm_id) AS id FROM placed
    LEFT JOIN chain n ON {_fold('placed.locality')} = {_fold('n.locality_name')} AND {_fold('placed.municipality')} = {_fold('n.municipality_name')}
    LEFT JOIN strip s ON is_valid AND x >= x0 AND x < x1 AND y >= y0 AND y < y0 + 1) f LEFT JOIN chain ON chain.locality_osm_id = f.id),
alike AS (SELECT u.postcode, p.postcode AS near_postcode, abs({_number('u.postcode')} - {_number('p.postcode')})::DOUBLE AS distance, p.locality_id AS locality_osm_id
  FROM (SELECT DISTINCT postal_code AS postcode FROM staged WHERE postal_code NOT IN (SELECT postcode FROM postcodes)) u JOIN postcodes p ON u.postcode[1:4] = p.postcode[1:4]
  QUALIFY row_number() OVER (PARTITION BY u.postcode ORDER BY abs({_number('u.postcode')} - {_number('p.postcode')}), p.postcode) = 1),
active AS (SELECT al_id, registration_number, registration_date, lodging_name AS name, is_building_post_1951, public_opening_date AS opening_date, house_type, beds, max_guests, rooms, address, postal_code,
    staged.locality, staged.municipality, staged.district, operator_name, operator_quality, operator_type, email, etl_timestamp = max(etl_timestamp) OVER () AS is_active,
    CASE WHEN etl_timestamp <> max(etl_timestamp) OVER () THEN max(etl_timestamp) OVER () END AS closed_month, lng, lat, real_postcode FROM staged LEFT JOIN postcodes ON postal_code = postcode)"""


def _mapped(of: str, code: str) -> str:
    return f"""SELECT l.*, c.* FROM {of} l LEFT JOIN chain n ON {_fold('l.locality')} = {_fold('n.locality_name')} AND {_fold('l.municipality')} = {_fold('n.municipality_name')} AND {_fold('l.district')} = {_fold('n.region_name')}
  LEFT JOIN postcodes p ON l.{code} = p.postcode LEFT JOIN alike k ON l.{code} = k.postcode JOIN chain c ON c.locality_osm_id = coalesce(n.locality_osm_id, p.locality_id, k.locality_osm_id) WHERE c.region_osm_id <> 104"""


_as_text = ", ".join(f"{c}::VARCHAR AS {c}" for c in ("registration_date", "opening_date", "closed_month"))
ORACLE_SQL = {
    "staged_licences": f"{CHAIN_SQL} SELECT * REPLACE (etl_timestamp::VARCHAR AS etl_timestamp, registration_date::VARCHAR AS registration_date, public_opening_date::VARCHAR AS public_opening_date) FROM staged",
    "code_aliases": f"{CHAIN_SQL} SELECT * FROM aliases",
    "postcode_chain": f"{CHAIN_SQL} SELECT * FROM postcodes",
    "similar_codes": f"{CHAIN_SQL} SELECT * FROM alike",
    "duplicate_codes": f"{CHAIN_SQL} SELECT DISTINCT postcode FROM bad_bulk",
    "active_licences": f"{CHAIN_SQL} SELECT * REPLACE ({_as_text}) FROM active",
    "mapped_licences": f"{CHAIN_SQL} SELECT * REPLACE ({_as_text}) FROM ({_mapped('active', 'real_postcode')})",
    "lost_mapped": f"""{CHAIN_SQL}, lost AS (SELECT al_id, locality, municipality, district, postal_code, (SELECT min(etl_timestamp) FROM staged s WHERE s.etl_timestamp > staged.etl_timestamp) AS lost_in FROM staged)
SELECT * REPLACE (lost_in::VARCHAR AS lost_in) FROM ({_mapped("(SELECT * FROM lost WHERE lost_in IS NOT NULL)", 'postal_code')})""",
    "mapping_checks": f"""{CHAIN_SQL}, al AS ({_mapped('active', 'real_postcode')})
SELECT 'al_unique' AS name, (SELECT count(*) FROM (SELECT al_id FROM al GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'al_unmapped_unique', (SELECT count(*) FROM (SELECT al_id FROM active GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'postcodes_unique', (SELECT count(*) FROM (SELECT postcode FROM postcodes GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'localities_have_one_parent', (SELECT count(*) FROM (SELECT locality_osm_id FROM al GROUP BY 1 HAVING count(DISTINCT municipality_osm_id) > 1))
UNION ALL SELECT 'postcodes_exist', (SELECT count(*) FROM al WHERE postal_code NOT IN (SELECT postcode FROM postcodes))
UNION ALL SELECT 'names_near_localities', (SELECT count(*) FROM (SELECT al_id FROM active JOIN chain ON {_fold('active.municipality')} = {_fold('municipality_name')}
  GROUP BY al_id HAVING min(levenshtein({_fold('active.locality')}, {_fold('locality_name')})) > 1))""",
}


def _plain(query):
    """The query with dates and times as text, so that rows of two engines can be compared."""
    formats = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss"}

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.date_format(c, formats[kind]) for c, kind in df.dtypes if kind in formats})

    return run


QUERIES = {
    f.__name__: _plain(f)
    for f in (staged_licences, code_aliases, postcode_chain, similar_codes, duplicate_codes, active_licences, mapped_licences, lost_mapped, mapping_checks)
}

"""SQL counterparts of the ingest, validation and building-block queries."""

from __future__ import annotations

from virosieve.functions.changes import CODON_TABLE
from virosieve.workload.binding import on_nucleotides, with_clause
from virosieve.workload.oracles import COMMON, DAYS, MONTH, WEEK, WW, _range_text
from virosieve.workload.queries import SAMPLE_WHERE
from virosieve.workload.raw import RAW


def sql(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    return with_clause(recursive, {**COMMON, **RAW, **(extra or {})}) + "\n" + body


def numbered(keys: str, after: str) -> str:
    """Id of new rows: by digest prefix, then by key."""
    text = ", ".join(f"cast({k.strip()} AS varchar)" for k in keys.split(","))
    order = ", ".join(f"{k.strip()} NULLS FIRST" for k in keys.split(","))
    return f"{after} + row_number() OVER (ORDER BY substr(md5(concat_ws('|', {text})), 1, 3), {order})"


def highest(table: str, column: str = "id") -> str:
    return f"(SELECT coalesce(max({column}), 0) FROM {table})"


def translate(codon: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{aa}'" for c, aa in CODON_TABLE.items())
    return f"CASE WHEN contains({codon}, 'N') THEN 'X' ELSE CASE {codon} {cases} END END"


def d(column: str) -> str:
    return f"cast({column} AS varchar) AS {column}"


def cleaning_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    first, year_end = "make_date(cast(y AS int), 1, 1)", "make_date(cast(y AS int), 12, 31)"
    month, month_end = "date_trunc('month', d)", "last_day(d)"
    start = f"CASE WHEN kind = 0 THEN {first} WHEN kind = 1 THEN {month} WHEN kind IN (2, 3, 4, 7) THEN d END"
    end = (f"CASE kind WHEN 0 THEN {year_end} WHEN 1 THEN {month_end} WHEN 2 THEN d WHEN 3 THEN d "
           f"WHEN 4 THEN {year_end} WHEN 7 THEN make_date(cast(y AS int) + 1, 12, 31) END")  # fmt: skip
    o["collection_window"] = sql(
        f"SELECT id, collection_date, cast(cast({start} AS date) AS varchar) AS collection_start_date, "
        f"cast(cast({end} AS date) AS varchar) AS collection_end_date, kind IN (5, 6) AS bad_collection_date "
        "FROM (SELECT r.*, collection_date FROM raw_dates r JOIN date_texts t ON t.id = r.id)"
    )
    o["clean_values"] = sql(
        "SELECT l_orderkey, l_linenumber, nullif(number_text, '') AS number_text, "
        "CASE WHEN number_text <> '' AND number_text LIKE '%.0' THEN cast(cast(number_text AS double) AS bigint) END AS whole, "
        "CASE WHEN flag_text <> '' THEN flag_text IN ('TRUE', 'true') END AS flag FROM raw_cells"
    )
    o["clean_feature_name"] = sql(
        "SELECT p_partkey, concat(p_type, CASE WHEN p_partkey % 4 = 0 THEN '.1' ELSE '' END) AS feature FROM part"
    )
    named = "CASE WHEN id % 7 <> 0 AND id % 11 <> 0 THEN {} END"
    o["parse_change"] = sql(
        f"SELECT id, {named.format('gff_feature')} AS feature, {named.format('ref_aa')} AS ref, "
        f"{named.format('position_aa')} AS position, {named.format('alt_aa')} AS alt FROM amino_acids"
    )
    o["mature_to_sequential"] = sql(
        "SELECT id, CASE WHEN p BETWEEN -16 AND -1 THEN p + 17 WHEN p BETWEEN 1 AND 552 THEN p + 16 END AS site "
        "FROM (SELECT id, id % 700 - 30 AS p FROM raw_accessions)"
    )
    o["exclude_accessions"] = sql(
        "SELECT id, accession FROM raw_accessions WHERE cast(substr(accession, 4) AS bigint) NOT BETWEEN 29182424 AND 29182485"
    )
    place = "CASE c_custkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} END"
    source = "FROM raw_places JOIN customer ON c_custkey = id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    o["split_geo"] = sql(
        "SELECT id, geo_location, " + ", ".join(
            f"CASE WHEN id % 5 = 0 THEN {v} END AS {n}"
            for n, v in (("country_name", "r_name"), ("admin1_name", "n_name"), ("admin2_name", "c_mktsegment"), ("admin3_name", "'x'"))
        ) + f", id % 5 IN (1, 2, 3) AS bad_geo {source}"
    )
    o["split_geo_trimmed"] = sql(
        f"SELECT id, geo_location, {place.format('r_name', 'r_name', 'r_name', 'r_name')} AS country_name, "
        f"{place.format('n_name', 'n_name', 'NULL', 'n_name')} AS admin1_name, "
        f"{place.format('c_mktsegment', 'NULL', 'NULL', chr(39) + 'a' + chr(39))} AS admin2_name, "
        f"CASE id % 5 WHEN 0 THEN 'x' WHEN 3 THEN 'b' END AS admin3_name, false AS bad_geo {source}"
    )
    geo = "country_name, admin1_name, admin2_name, admin3_name"
    upserted = {
        "new_places": f"SELECT DISTINCT {geo} FROM place_tuples EXCEPT SELECT {geo} FROM known_places",
        "all_places": f"SELECT id, {geo} FROM known_places UNION ALL "
        f"SELECT {numbered(geo, highest('known_places'))}, {geo} FROM new_places",
    }
    o["geo_dimension_upsert"] = sql(f"SELECT id, {geo} FROM all_places", upserted)
    o["geo_dimension_upsert_ids"] = sql(
        "SELECT customer, p.id AS geo_location_id FROM place_tuples t JOIN all_places p ON p.country_name = t.country_name "
        "AND p.admin1_name = t.admin1_name AND p.admin2_name IS NOT DISTINCT FROM t.admin2_name",
        upserted,
    )
    o["sample_upsert"] = sql(
        "SELECT s.id, s.accession, CASE WHEN n.accession IS NULL THEN s.host ELSE n.host END AS host, "
        "CASE WHEN n.accession IS NULL THEN s.organism ELSE n.organism END AS organism, s.platform, "
        f"{d('s.collection_start_date').replace('AS s.', 'AS ')}, {d('s.collection_end_date').replace('AS s.', 'AS ')} "
        "FROM stored_samples s LEFT JOIN incoming_samples n ON n.accession = s.accession UNION ALL "
        f"SELECT {numbered('accession', highest('stored_samples'))}, accession, host, organism, NULL, "
        "cast(collection_start_date AS varchar), cast(collection_end_date AS varchar) "
        "FROM incoming_samples WHERE accession NOT IN (SELECT accession FROM stored_samples)"
    )
    o["sample_id_lookup"] = sql(
        "SELECT accession, id AS sample_id FROM samples WHERE accession IN (SELECT accession FROM raw_mutations)"
    )
    o["drop_unknown_accessions"] = sql("SELECT * FROM raw_mutations WHERE accession IN (SELECT accession FROM samples)")
    o["drop_null_ref"] = sql("SELECT * FROM raw_mutations WHERE ref_nt IS NOT NULL")
    nt = ("accession, region, position_nt, ref_nt, alt_nt, gapped_dp, round(cast(gapped_freq AS double), 6) AS gapped_freq")
    o["filter_intrahost_nt"] = sql(
        f"SELECT {nt} FROM raw_ih_nt WHERE alt_nt <> ref_nt AND gapped_freq >= 0.02 AND coalesce(gapped_dp, 10) >= 10"
    )
    o["filter_intrahost_codons"] = sql(
        "SELECT * REPLACE (round(alt_freq, 6) AS alt_freq) FROM raw_ih_codons "
        "WHERE alt_codon <> ref_codon AND alt_freq >= 0.02 AND alt_dp >= 10"
    )
    o["translate_codon"] = sql(f"SELECT accession, ref_codon, {translate('ref_codon')} AS ref_aa FROM raw_ih_codons")
    return o


def change_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    nt_key, aa_key = "region, position_nt, alt_nt", "gff_feature, position_aa, alt_aa, alt_codon"
    staged = {
        "staged_nt": "SELECT * FROM (SELECT region, position_nt, ref_nt, alt_nt FROM ok_mutations UNION "
        "SELECT region, position_nt, ref_nt, alt_nt FROM ok_ih_nt) "
        f"WHERE ({nt_key}) NOT IN (SELECT ({nt_key}) FROM known_alleles)",
        "staged_aa": "SELECT * FROM (SELECT gff_feature, position_aa, alt_aa, alt_codon, ref_aa, ref_codon FROM ok_mutations "
        f"UNION SELECT gff_feature, position_aa, {translate('alt_codon')}, alt_codon, {translate('ref_codon')}, ref_codon FROM ok_ih_codons) "
        "WHERE gff_feature IS NOT NULL AND position_aa IS NOT NULL AND alt_aa IS NOT NULL AND alt_codon IS NOT NULL "
        f"AND ref_aa IS NOT NULL AND ref_codon IS NOT NULL AND ({aa_key}) NOT IN (SELECT ({aa_key}) FROM known_amino_acids)",
    }
    o["build_allele_catalog"] = sql(
        f"SELECT {numbered(nt_key, highest('known_alleles'))} AS id, {nt_key}, ref_nt FROM "
        f"(SELECT {nt_key}, min(ref_nt) AS ref_nt FROM staged_nt GROUP BY {nt_key})",
        staged,
    )
    o["allele_ref_conflicts"] = sql(
        f"SELECT DISTINCT 'ref_nt' AS field, {nt_key}, ref_nt AS ref FROM staged_nt WHERE ({nt_key}) IN "
        f"(SELECT ({nt_key}) FROM staged_nt GROUP BY {nt_key} HAVING count(DISTINCT ref_nt) > 1)",
        staged,
    )
    o["build_amino_acid_catalog"] = sql(
        f"SELECT {numbered(aa_key, highest('known_amino_acids'))} AS id, {aa_key}, ref_aa, ref_codon FROM (SELECT *, row_number() "
        f"OVER (PARTITION BY {aa_key} ORDER BY ref_aa, ref_codon) AS r FROM staged_aa) WHERE r = 1",
        staged,
    )
    o["amino_acid_ref_conflicts"] = sql(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{f}' AS field, {aa_key}, {f} AS ref FROM staged_aa WHERE ({aa_key}) IN "
            f"(SELECT ({aa_key}) FROM staged_aa GROUP BY {aa_key} HAVING count(DISTINCT {f}) > 1)"
            for f in ("ref_codon", "ref_aa")
        ),
        staged,
    )
    bins = {"bins": "SELECT k, cast(k AS decimal(6,2)) / 20 AS lo, cast(k + 1 AS decimal(6,2)) / 20 AS hi FROM range(20) AS r(k)"}
    contains = "{f} >= k / 20 AND ({f} < (k + 1) / 20 OR (k = 19 AND {f} <= 1))"
    o["assign_freq_bin"] = sql(
        "SELECT accession, region, position_nt, ref_nt, alt_nt, gapped_dp, round(cast(gapped_freq AS double), 6) AS gapped_freq, "
        f"k AS freq_bin FROM raw_ih_nt LEFT JOIN bins ON {contains.format(f='gapped_freq')}",
        bins,
    )

    def edges(records: str, catalog: str, key: str, where: str = "true", freq: str | None = None) -> str:
        on = " AND ".join(f"c.{k.strip()} = r.{k.strip()}" for k in key.split(","))
        binned = f" JOIN bins ON {contains.format(f='r.' + freq)}" if freq else ""
        return sql(
            f"SELECT DISTINCT c.id AS change_id, s.id AS sample_id{', k AS freq_bin' if freq else ''} FROM {records} r "
            f"JOIN {catalog} c ON {on} JOIN samples s ON s.accession = r.accession{binned} WHERE {where}",
            bins,
        )

    o["carriers_cns_allele"] = edges("ok_mutations", "full_alleles", nt_key)
    o["carriers_cns_amino_acid"] = edges("ok_mutations", "full_amino_acids", aa_key, "r.ref_aa IS NOT NULL")
    o["carriers_ih_allele"] = edges("ok_ih_nt", "full_alleles", nt_key, freq="gapped_freq")
    o["carriers_ih_amino_acid"] = edges("ok_ih_codons", "full_amino_acids", "gff_feature, position_aa, alt_codon", freq="alt_freq")
    o["carrier_union_merge"] = sql("SELECT change_id, sample_id FROM cns_edges")
    o["transpose_carriers"] = sql("SELECT sample_id, change_id FROM cns_edges")
    o["carrier_bitmaps"] = sql(
        "SELECT change_id, CASE WHEN sample_id > 0 THEN (sample_id - 1) // 32768 + 1 ELSE 0 END AS bucket, count(*) AS n "
        "FROM cns_edges GROUP BY ALL"
    )
    return o


def dimension_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    key = "gff_feature, position_aa, ref_aa, alt_aa"
    columns = f"{key}, phenotype_metric_name, phenotype_metric_assay_type, value, input_order"
    o["lookup_equivalent_changes"] = sql(
        f"SELECT {columns}, id AS amino_acid_id FROM raw_scores JOIN amino_acids USING ({key})"
    )
    o["lookup_equivalent_changes_missing"] = sql(
        f"SELECT {columns} FROM raw_scores WHERE ({key}) NOT IN (SELECT ({key}) FROM amino_acids)"
    )
    metrics = {
        "new_metrics": "SELECT phenotype_metric_name, min(phenotype_metric_assay_type) AS phenotype_metric_assay_type FROM {} "
        "WHERE phenotype_metric_name NOT IN (SELECT phenotype_metric_name FROM phenotype_metrics) GROUP BY phenotype_metric_name",
        "all_metrics": "SELECT id, phenotype_metric_name, phenotype_metric_assay_type FROM phenotype_metrics UNION ALL SELECT "
        f"{numbered('phenotype_metric_name', highest('phenotype_metrics'))}, phenotype_metric_name, phenotype_metric_assay_type FROM new_metrics",
    }
    o["metric_dimension_upsert"] = sql(
        "SELECT * FROM all_metrics", {**metrics, "new_metrics": metrics["new_metrics"].format("raw_scores")}
    )
    o["metric_value_upsert"] = sql(
        "SELECT coalesce(n.phenotype_metric_id, v.phenotype_metric_id) AS phenotype_metric_id, "
        "coalesce(n.amino_acid_id, v.amino_acid_id) AS amino_acid_id, round(coalesce(n.value, v.value), 6) AS value "
        "FROM phenotype_metric_values v FULL JOIN last n ON n.phenotype_metric_id = v.phenotype_metric_id AND n.amino_acid_id = v.amino_acid_id",
        {
            "found": f"SELECT r.*, a.id AS amino_acid_id FROM raw_scores r JOIN amino_acids a USING ({key})",
            **metrics,
            "new_metrics": metrics["new_metrics"].format("found"),
            "last": "SELECT m.id AS phenotype_metric_id, amino_acid_id, value FROM (SELECT *, row_number() OVER "
            "(PARTITION BY phenotype_metric_name, amino_acid_id ORDER BY input_order DESC) AS r FROM found) f "
            "JOIN all_metrics m USING (phenotype_metric_name) WHERE r = 1",
        },
    )

    def lineages(names: str, system: str, system_id: int) -> dict[str, str]:
        return {
            "new_names": f"SELECT DISTINCT lineage_name FROM {names} WHERE lineage_name IS NOT NULL AND lineage_name NOT IN "
            f"(SELECT lineage_name FROM lineages WHERE lineage_system_id = {system_id})",
            "all_lineages": "SELECT id, lineage_system_id, lineage_name FROM lineages UNION ALL "
            f"SELECT {numbered('lineage_name', highest('lineages'))}, {system_id}, lineage_name FROM new_names",
            "own": f"SELECT id, lineage_name FROM all_lineages WHERE lineage_system_id = {system_id}",
        }

    o["lineage_dimension_upsert"] = sql("SELECT * FROM all_lineages", lineages("raw_calls", "consensus", 1))
    first = {
        "first_calls": "SELECT s.id AS sample_id, lineage_name FROM (SELECT accession, lineage_name, row_number() OVER "
        "(PARTITION BY accession ORDER BY input_order) AS r FROM raw_calls WHERE lower(lineage_name) NOT LIKE 'not assigned%') c "
        "JOIN samples s ON s.accession = c.accession WHERE r = 1"
    }
    o["ingest_consensus_lineages"] = sql(
        "SELECT sample_id, lineage_id, round(abundance, 6) AS abundance, is_consensus_call FROM samples_lineages UNION ALL "
        "SELECT sample_id, own.id, NULL, true FROM first_calls JOIN own USING (lineage_name) "
        "WHERE (sample_id, own.id) NOT IN (SELECT (sample_id, lineage_id) FROM samples_lineages WHERE is_consensus_call)",
        {**first, **lineages("first_calls", "consensus", 1)},
    )
    o["ingest_demixed_abundance"] = sql(
        "SELECT coalesce(n.sample_id, c.sample_id) AS sample_id, coalesce(n.lineage_id, c.lineage_id) AS lineage_id, "
        "round(coalesce(n.abundance, c.abundance), 6) AS abundance, coalesce(c.is_consensus_call, false) AS is_consensus_call "
        "FROM samples_lineages c FULL JOIN incoming n ON n.sample_id = c.sample_id AND n.lineage_id = c.lineage_id AND NOT c.is_consensus_call",
        {
            "last": "SELECT s.id AS sample_id, lineage_name, abundance FROM (SELECT *, row_number() OVER "
            "(PARTITION BY accession, lineage_name ORDER BY input_order DESC) AS r FROM raw_abundances) a "
            "JOIN samples s ON s.accession = a.accession WHERE r = 1",
            **lineages("last", "demixed", 2),
            "incoming": "SELECT sample_id, own.id AS lineage_id, abundance FROM last JOIN own USING (lineage_name)",
        },
    )
    hierarchy = {
        "clean": "SELECT DISTINCT rtrim(parent_name, '*') AS parent_name, rtrim(child_name, '*') AS child_name FROM raw_hierarchy",
        "names": "SELECT parent_name AS lineage_name FROM clean UNION SELECT child_name FROM clean",
        **lineages("names", "demixed", 2),
        "wanted": "SELECT p.id AS parent_id, c.id AS child_id FROM clean JOIN own p ON p.lineage_name = parent_name "
        "JOIN own c ON c.lineage_name = child_name",
        "stored": "SELECT parent_id, child_id FROM lineages_immediate_children WHERE parent_id IN (SELECT id FROM own)",
    }
    o["sync_lineage_hierarchy"] = sql(
        "SELECT *, 'kept' AS action FROM (SELECT * FROM wanted INTERSECT SELECT * FROM stored) UNION ALL "
        "SELECT *, 'added' FROM (SELECT * FROM wanted EXCEPT SELECT * FROM stored) UNION ALL "
        "SELECT *, 'dropped' FROM (SELECT * FROM stored EXCEPT SELECT * FROM wanted)",
        hierarchy,
    )
    o["sync_lineage_hierarchy_edges"] = sql(
        "SELECT parent_id, child_id FROM wanted UNION ALL SELECT parent_id, child_id FROM lineages_immediate_children "
        "WHERE parent_id NOT IN (SELECT id FROM own)",
        hierarchy,
    )

    # id sets as sorted lists
    annotated = {
        "named": "SELECT DISTINCT marker_id, effect_detail, CASE WHEN gff_feature <> 'XX' THEN gff_feature END AS gff_feature, "
        "position_aa, ref_aa, alt_aa FROM (SELECT *, split_part(aa_change, ':', 1) AS gff_feature, "
        "substr(split_part(aa_change, ':', 2), 1, 1) AS ref_aa, right(aa_change, 1) AS alt_aa, "
        "cast(substr(split_part(aa_change, ':', 2), 2, length(split_part(aa_change, ':', 2)) - 2) AS bigint) AS position_aa FROM raw_markers)",
        "sets": "SELECT marker_id, effect_detail, list_sort(list(DISTINCT a.id)) AS ids FROM named n "
        f"LEFT JOIN amino_acids a USING ({key}) GROUP BY marker_id, effect_detail HAVING bool_and(a.id IS NOT NULL)",
        "old_sets": "SELECT effect_detail, list_sort(list(DISTINCT amino_acid_id)) AS ids FROM known_annotations "
        "JOIN known_annotation_members USING (annotation_id) GROUP BY annotation_id, effect_detail",
        "fresh": "SELECT marker_id, effect_detail, ids FROM (SELECT *, row_number() OVER (PARTITION BY effect_detail, ids "
        "ORDER BY marker_id) AS r FROM sets) WHERE r = 1 AND (effect_detail, ids) NOT IN (SELECT (effect_detail, ids) FROM old_sets)",
        "added": f"SELECT {numbered('marker_id, effect_detail', highest('known_annotations', 'annotation_id'))} AS annotation_id, * FROM fresh",
        "usable": "SELECT r.* FROM raw_markers r JOIN sets USING (marker_id, effect_detail)",
    }
    o["ingest_annotations"] = sql(
        "SELECT annotation_id, effect_detail, amino_acid_id FROM known_annotations JOIN known_annotation_members USING (annotation_id) "
        "UNION ALL SELECT annotation_id, effect_detail, unnest(ids) FROM added",
        annotated,
    )
    paper = "authors, publication_year, title"
    o["ingest_annotations_papers"] = sql(f"SELECT {paper} FROM papers UNION SELECT {paper} FROM usable", annotated)
    o["ingest_annotations_effects"] = sql(
        "SELECT effect_detail AS detail FROM known_annotations UNION SELECT effect_detail FROM usable", annotated
    )
    o["ingest_annotations_citations"] = sql(
        "SELECT annotation_id, 1 AS n FROM known_annotations UNION ALL "
        f"SELECT annotation_id, count(DISTINCT ({paper})) FROM added JOIN usable USING (marker_id, effect_detail) GROUP BY annotation_id",
        annotated,
    )
    return o


def validation_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["check_bin_overlap"] = sql(
        "SELECT DISTINCT a.* FROM odd_ranges a JOIN odd_ranges b ON a.change_id = b.change_id AND "
        "(a.lo, a.hi, a.hi_closed) <> (b.lo, b.hi, b.hi_closed) AND (a.lo < b.hi OR (a.lo = b.hi AND b.hi_closed)) "
        "AND (b.lo < a.hi OR (b.lo = a.hi AND a.hi_closed))"
    )
    o["check_sample_once_per_change"] = sql(
        "SELECT change_id, sample_id, min(freq_bin) AS first_bin, max(freq_bin) AS last_bin FROM ih_edges "
        "GROUP BY change_id, sample_id HAVING count(DISTINCT freq_bin) > 1"
    )
    o["check_lineage_cycle"] = sql(
        "SELECT DISTINCT parent_id, child_id FROM odd_edges WHERE (child_id, parent_id) IN (SELECT (parent_id, child_id) FROM deep)",
        {
            "deep": "SELECT parent_id, child_id FROM odd_edges UNION "
            "SELECT x.parent_id, e.child_id FROM deep x JOIN odd_edges e ON x.child_id = e.parent_id"
        },
        recursive=True,
    )
    o["check_cross_system_edge"] = sql(
        "SELECT parent_id, child_id, p.lineage_system_id AS parent_system, c.lineage_system_id AS child_system FROM odd_edges "
        "JOIN lineages p ON p.id = parent_id JOIN lineages c ON c.id = child_id WHERE p.lineage_system_id <> c.lineage_system_id"
    )
    o["check_sample_rows"] = sql(
        "SELECT id, 'both collection dates or none' AS rule FROM odd_samples WHERE (collection_start_date IS NULL) <> (collection_end_date IS NULL) "
        "UNION ALL SELECT id, 'collection start not after end' FROM odd_samples WHERE collection_start_date > collection_end_date "
        "UNION ALL SELECT id, 'retraction flag and date agree' FROM odd_samples WHERE is_retracted <> (retraction_detected_date IS NOT NULL)"
    )
    o["check_abundance_xor_consensus"] = sql(
        "SELECT sample_id, lineage_id, round(abundance, 6) AS abundance, is_consensus_call FROM odd_calls "
        "WHERE (abundance IS NULL) <> is_consensus_call"
    )
    o["check_non_empty"] = sql("SELECT * FROM odd_amino_acids WHERE gff_feature = '' OR alt_codon = ''")
    o["check_no_self_parent"] = sql("SELECT parent_id, child_id FROM odd_edges WHERE parent_id = child_id")
    o["check_unique"] = sql(
        "SELECT region, position_nt, alt_nt, count(*) AS n FROM alleles GROUP BY region, position_nt, alt_nt HAVING count(*) > 1"
    )
    from virosieve.operators.validate import NATURAL_KEYS, REFERENCES
    from virosieve.workload.binding import _FRAME_OF

    o["check_unique_all"] = sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_violations FROM (SELECT 1 FROM {_FRAME_OF[t]} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
            for t, k in NATURAL_KEYS.items()
        )
    )
    o["check_references"] = sql(
        "SELECT phenotype_metric_id, amino_acid_id, round(value, 6) AS value FROM odd_values "
        "WHERE amino_acid_id NOT IN (SELECT id FROM amino_acids)"
    )
    o["check_references_all"] = sql(
        " UNION ALL ".join(
            f"SELECT '{t}.{c}' AS reference, count(*) AS n_violations FROM {_FRAME_OF[t]} "
            f"WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {_FRAME_OF[p]})"
            for t, c, p, k in REFERENCES
        )
    )
    return o


def building_block_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["sample_filter"] = sql(f"SELECT id FROM sg WHERE {SAMPLE_WHERE}")
    o["sample_filter_lineages"] = sql("SELECT DISTINCT id FROM sgi WHERE abundance > 0.4 OR lineage_name = 'N3'")
    mid = "collection_start_date + cast((collection_end_date - collection_start_date) // 2 AS int)"
    o["mid_collection_date"] = sql(f"SELECT id, cast({mid} AS varchar) AS mid_collection_date FROM samples")
    o["max_span_filter"] = sql("SELECT id FROM samples WHERE collection_end_date - collection_start_date <= 100")
    for name, b in (("month", MONTH), ("week", WEEK), ("days", DAYS)):
        o[f"date_bin_{name}"] = sql(
            f"SELECT id, {b.shown} FROM d", {"d": f"SELECT id, {b.columns('m')} FROM (SELECT id, {mid} AS m FROM samples)"}
        )
    o["date_bin_iso_week"] = sql(
        "SELECT id, isoyear(collection_start_date) AS year, week(collection_start_date) AS chunk FROM samples"
    )
    o["bin_group_order"] = sql(
        "SELECT host, year(collection_start_date) AS year, month(collection_start_date) AS chunk, platform, count(*) AS n "
        "FROM samples GROUP BY ALL"
    )
    o["change_axis"] = sql(
        "SELECT id AS change_id, gff_feature, ref_aa, position_aa, alt_aa FROM amino_acids"
    )
    o["freq_overlap_filter"] = sql(
        f"SELECT change_id, sample_id, {_range_text()} AS alt_freq_range FROM ihf WHERE f_lo <= 0.5 AND f_hi > 0.25"
    )
    o["freq_overlap_filter"] = on_nucleotides(o["freq_overlap_filter"])
    o["ww_flag"] = sql(f"SELECT id, {WW} AS is_wastewater FROM samples")
    return o


def ingest_oracles() -> dict[str, str]:
    return {
        **cleaning_oracles(), **change_oracles(), **dimension_oracles(), **validation_oracles(), **building_block_oracles(),
    }

"""SQL counterparts of the reader and writer queries."""

from __future__ import annotations

from virosieve.sources.samples import RUN_COLUMNS
from virosieve.workload.ingest_oracles import change_oracles, sql


def source_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    plain = [c for c in RUN_COLUMNS if c not in (
        "avg_spot_length", "bases", "collection_date", "geo_loc_name", "release_date", "creation_date",
        "is_retracted", "retraction_detected_date")]
    texts = ", ".join(f"nullif({c}, '') AS {c}" for c in plain)
    malformed = ("(geo_loc_name IS NOT NULL AND len(string_split(geo_loc_name, '/')) <> 4) OR bio_sample_model IS NULL "
                 "OR bases LIKE '%.%'")  # fmt: skip
    four = "len(string_split(geo_loc_name, '/')) = 4"
    places = ", ".join(
        f"CASE WHEN {four} THEN split_part(geo_loc_name, '/', {i}) END AS {n}"
        for i, n in enumerate(("country_name", "admin1_name", "admin2_name", "admin3_name"), 1)
    )
    o["src_samples_delimited"] = sql(
        f"SELECT {texts}, cast(avg_spot_length AS double) AS avg_spot_length, "
        "CASE WHEN bases NOT LIKE '%.%' THEN cast(bases AS bigint) END AS bases, "
        "concat(substr(release_date, 1, 10), ' 10:20:30') AS release_date, "
        "creation_date || ' 00:00:00' AS creation_date, "
        "substr(retraction_detected_date, 1, 10) || ' 00:00:00' AS retraction_detected_date, is_retracted = 'True' AS is_retracted, "
        "collection_date AS collection_start_date, collection_date AS collection_end_date, "
        f"{places}, false AS bad_collection_date, {malformed} AS malformed FROM (SELECT * REPLACE "
        "(nullif(retraction_detected_date, 'T00:00:00') AS retraction_detected_date) FROM file_runs)"
    )
    o["src_samples_delimited_tsv"] = sql(
        f"SELECT accession, CASE WHEN bases NOT LIKE '%.%' THEN cast(bases AS bigint) END AS bases, {malformed} AS malformed, center_name FROM file_runs"
    )
    o["src_samples_bulk_sd"] = sql(
        "SELECT accession, host, split_part(geo_location, ' / ', 1) AS country_name, split_part(geo_location, ' / ', 2) AS admin1_name, "
        "cast(NULL AS varchar) AS admin2_name, cast(NULL AS varchar) AS admin3_name, false AS bad_geo, collection_date AS collection_start_date, "
        "collection_date AS collection_end_date, false AS bad_collection_date, 'NA' AS organism, false AS is_retracted "
        "FROM file_sd WHERE collection_date IS NOT NULL"
    )
    missing = "cast(NULL AS varchar)"
    for name, split, organism in (("wastewater", False, "organism"), ("ncbi", True, "'NA'")):
        parts = [f"split_part(geo_location, ':', {i})" for i in (1, 2, 3)] if split else ["geo_location", missing, missing]
        o[f"src_samples_bulk_{name}"] = sql(
            f"SELECT accession, bio_project, bio_sample, host, isolate, {organism} AS organism, isolation_source, census_region, "
            "cast(bases AS bigint) AS bases, round(cast(ww_viral_load AS double), 6) AS ww_viral_load, "
            "cast(ww_catchment_population AS bigint) AS ww_catchment_population, ww_site_id, ww_collected_by, "
            f"{parts[0]} AS country_name, {parts[1]} AS admin1_name, {parts[2]} AS admin2_name, {missing} AS admin3_name, false AS bad_geo, "
            "cast(cast(date_trunc('month', m) AS date) AS varchar) AS collection_start_date, cast(last_day(m) AS varchar) AS collection_end_date, "
            "false AS bad_collection_date, false AS is_retracted FROM file_bulk JOIN (SELECT accession, collection_start_date AS m FROM samples) "
            "USING (accession) WHERE m IS NOT NULL"
        )
    o["src_consensus_mutations"] = sql("SELECT * FROM raw_mutations")
    o["src_intrahost_nt"] = sql(
        "SELECT * REPLACE (cast(ref_qual AS double) AS ref_qual, cast(alt_qual AS double) AS alt_qual, "
        "round(cast(alt_freq AS double), 6) AS alt_freq, round(cast(gapped_freq AS double), 6) AS gapped_freq, cast(pval AS double) AS pval, "
        "cast(std_dev AS double) AS std_dev, cast(amp_freq AS double) AS amp_freq) FROM file_ih_nt"
    )
    o["src_intrahost_codons"] = sql("SELECT * REPLACE (round(alt_freq, 6) AS alt_freq) FROM file_ih_codons")
    o["src_classify_by_header"] = sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS record_type, accession, 2 * count(*) AS n FROM {r} GROUP BY accession"
            for t, r in (("mutations", "raw_mutations"), ("intrahost_nt", "raw_ih_nt"), ("intrahost_codons", "raw_ih_codons"))
        )
    )
    o["src_demixed_dir"] = sql("SELECT accession, lineage_name, round(abundance, 6) AS abundance, input_order FROM file_demixed")
    o["src_demixed_dir_malformed"] = sql(
        "SELECT accession, CASE kind WHEN 0 THEN 'accession differs from the file name' WHEN 1 THEN 'no lineages line' "
        "WHEN 2 THEN 'no abundances line' WHEN 3 THEN 'an abundance is not a number' "
        # without its only number the line holds an empty text
        "ELSE CASE WHEN n = 1 THEN 'an abundance is not a number' ELSE 'lineages and abundances differ in length' END END AS problem "
        "FROM (SELECT accession, cast(substr(accession, 2) AS bigint) % 5 AS kind, count(*) AS n FROM file_demixed GROUP BY accession)"
    )
    o["src_consensus_lineages"] = sql("SELECT accession, lineage_name FROM raw_calls")
    o["src_consensus_lineages_csv"] = o["src_consensus_lineages"]
    o["src_lineage_edges"] = sql("SELECT parent_name, child_name FROM raw_hierarchy")

    def scores(metrics: dict[str, str], feature: str, assay: str) -> str:
        return sql(
            " UNION ALL ".join(
                f"SELECT {feature} AS gff_feature, position_aa, ref_aa, alt_aa, '{name}' AS phenotype_metric_name, "
                f"try_cast({column} AS double) AS value, '{assay}' AS phenotype_metric_assay_type FROM file_scores "
                f"WHERE alt_aa IS NOT NULL AND try_cast({column} AS double) IS NOT NULL"
                for name, column in metrics.items()
            )
        )

    o["src_scores_wide"] = scores({"stability": "stability", "mouse_sera_escape": "escape"}, "'XAJ25415.1'", "DMS")
    o["src_scores_wide_sc2"] = scores({"delta_bind": "stability"}, "gff_feature", "DMS")
    o["src_scores_evescape"] = scores({"evescape": "stability", "evescape_sigmoid": "escape"}, "'XAJ25415.1'", "EVEscape")
    ha = "'XAJ25415.1'"
    o["src_scores_ha_tsv"] = scores({"stability": "stability", "ferret_sera_escape": "escape"}, ha, "DMS")
    new = {"sa26_usage_increase_new": "stability", "entry_in_sa26_and_sa23_293t_cells": "escape"}
    o["src_scores_ha_csv_new"] = scores(new, ha, "DMS")
    o["src_scores_ha_csv_neuac_neugc"] = scores({"entry_in_neuac": "stability", "neugc_usage_increase": "escape"}, ha, "DMS")
    o["src_scores_pb2_csv"] = scores({"mutdiffsel": "stability"}, "'XAJ25426.1'", "DMS")
    o["src_scores_sc2_evescape_csv"] = scores({"evescape": "stability"}, "gff_feature", "EVEscape")
    site = "concat(cast(position_aa AS varchar), ',', ref_aa, ',', coalesce(alt_aa, ''))"
    unread = "stability IS NOT NULL AND try_cast(stability AS double) IS NULL"
    o["src_scores_rejects"] = sql(
        f"SELECT 'no readable change' AS problem, NULL AS phenotype_metric_name, {site} AS cell, true AS has_place FROM file_scores WHERE alt_aa IS NULL "
        f"UNION ALL SELECT 'not a number', 'stability', stability, true FROM file_scores WHERE alt_aa IS NOT NULL AND {unread}"
    )
    o["src_scores_staged"] = sql(
        "SELECT n_scores AS scores_stored, value_sum, n_records_rejected + n_cells_rejected AS rejects_stored, n_scores, n_records_rejected, n_cells_rejected "
        "FROM (SELECT cast(sum(CASE WHEN alt_aa IS NULL THEN 0 WHEN try_cast(stability AS double) IS NULL THEN 1 ELSE 2 END) AS bigint) AS n_scores, "
        "round(sum(CASE WHEN alt_aa IS NOT NULL THEN coalesce(try_cast(stability AS double), 0) + try_cast(escape AS double) END), 6) AS value_sum, "
        "count(*) FILTER (alt_aa IS NULL) AS n_records_rejected, "
        f"count(*) FILTER (alt_aa IS NOT NULL AND {unread}) AS n_cells_rejected FROM file_scores)"
    )
    # a second file holds one of the two metrics
    o["src_scores_differing_metrics"] = f"({o['src_scores_wide']}) UNION ALL ({scores({'stability': 'stability'}, ha, 'DMS')})"
    o["load_samples"] = sql(
        "SELECT accession, center_name FROM (SELECT accession, nullif(center_name, '') AS center_name FROM file_runs "
        f"WHERE NOT coalesce({malformed}, false) UNION ALL SELECT s.accession, 'old' FROM samples s WHERE s.id % 3 = 0 "
        f"AND s.accession NOT IN (SELECT accession FROM file_runs WHERE NOT coalesce({malformed}, false)))"
    )
    loaded = "SELECT b.* FROM file_bulk b JOIN samples s USING (accession) WHERE s.collection_start_date IS NOT NULL"
    o["load_samples_bulk"] = sql(
        "SELECT b.accession, b.isolate, "
        "CASE WHEN s.id IS NOT NULL THEN 'site' ELSE b.ww_site_id END AS ww_site_id "
        f"FROM ({loaded}) b LEFT JOIN (SELECT * FROM samples WHERE id % 3 = 0) s ON s.accession = b.accession "
        "UNION ALL SELECT s.accession, 'old', 'site' FROM samples s WHERE s.id % 3 = 0 "
        f"AND s.accession NOT IN (SELECT accession FROM ({loaded}))"
    )
    o["src_annotations"] = sql("SELECT * FROM raw_markers")
    o["sink_tables"] = sql("SELECT * FROM stored_edges UNION ALL SELECT * FROM incoming_edges")
    o["sink_conflict_report"] = change_oracles()["allele_ref_conflicts"]
    return o

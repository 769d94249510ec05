"""The queries of this subpackage: name -> function, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from strandline.llm import audit, chunks, decontaminate, langid, mtree, packing, perspectives, quality, reshard, simhash, spelling, suffix, warc


def queries():
    return {
        "op1_warc": warc.op1,
        "op2_suffix_dedup": suffix.op2,
        "op3_language_id": langid.op3,
        "op4_quality_rules": quality.op4,
        "op5_perspectives": perspectives.op5,
        "op6_chunk_dedup": chunks.op6,
        "op7_decontamination": decontaminate.op7,
        "op8_packing": packing.op8,
        "op9_reshard": reshard.op9,
        "op10_simhash": simhash.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_mtree_topk": mtree.op12,
        "op13_filter_audit": audit.op13,
    }


def oracle_sql():
    return {"op1_warc": warc.SQL, "op5_perspectives": perspectives.SQL, "op12_mtree_topk": mtree.SQL, "op13_filter_audit": audit.SQL}

"""The queries of this package, by operator number, and their SQL where there is any."""

from __future__ import annotations

from . import huffman, kernels, langid, lloyd, mixing, packing, pii, prefixes, quality, simhash, urlfilter, vectors, warc

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_bayes_language_id,
        vectors.op2_graph_near_vectors,
        simhash.op3_simhash_dedup,
        pii.op4_bootstrapped_pii,
        quality.op5_decision_list_quality,
        huffman.op6_huffman_token_ids,
        urlfilter.op7_url_filter,
        mixing.op8_pivotal_mixing,
        warc.op9_zip_warc,
        packing.op10_bm25_packing,
        lloyd.op11_dimension_sharded_lloyd,
        kernels.op12_fourier_quality,
        prefixes.op13_prefix_trie,
    )
}
ORACLES = {"op7_url_filter": urlfilter.OP7_SQL, "op9_zip_warc": warc.OP9_SQL, "op11_dimension_sharded_lloyd": lloyd.OP11_SQL, "op13_prefix_trie": prefixes.OP13_SQL}

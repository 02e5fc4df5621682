"""The operators' driver queries and their SQL."""

from tallyweave.llm import ann, bpe_stream, collocations, crf_langid, licences, minhash, packing, pii, quality, substring, topk, url_filter, variants


def queries() -> dict:
    return {
        "op1_ann": ann.query,
        "op2_url_filter": url_filter.query,
        "op3_packing": packing.query,
        "op4_substring": substring.query,
        "op5_pii": pii.query,
        "op6_bpe": bpe_stream.query,
        "op7_topk": topk.query,
        "op8_minhash": minhash.query,
        "op9_licences": licences.query,
        "op10_langid": crf_langid.query,
        "op11_variants": variants.query,
        "op12_quality": quality.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql() -> dict:
    return {"op2_url_filter": url_filter.SQL, "op7_topk": topk.SQL, "op8_minhash": minhash.SQL, "op11_variants": variants.SQL, "op13_collocations": collocations.SQL}

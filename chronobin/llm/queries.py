"""The queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from . import embeddings, licenses, media, mixing, sentencepieces, sharding, simhash, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_query,
        "op2_mixing": mixing.op2_query,
        "op3_sentencepiece": sentencepieces.op3_query,
        "op4_toxicity": toxicity.op4_query,
        "op5_sharding": sharding.op5_query,
        "op6_urlfilter": urlfilter.op6_query,
        "op7_embeddings": embeddings.op7_query,
        "op8_media": media.op8_query,
        "op9_licenses": licenses.op9_query,
        "op10_warc": warc.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op5_sharding": sharding.op5_sql(), "op6_urlfilter": urlfilter.OP6_SQL, "op9_licenses": licenses.op9_sql(), "op10_warc": warc.OP10_SQL}

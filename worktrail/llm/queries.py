"""One query per operator, over its whole table with production parameters."""

from worktrail.llm import (ann, bpe, chat, cuckoo, hardneg, jaccard, packing, pii, quality,
                           repair, secret_scan, tokencount, urls)
from worktrail.llm.common import table

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(s, d):
    return bpe.digest(table(s, d, "documents"))


@query
def op2_url_filter(s, d):
    pages = table(s, d, "pages")
    return urls.judge(pages, urls.bad_host_urls(pages), urls.RULES)


ORACLE["op2_url_filter"] = urls.SQL


@query
def op6_token_counts(s, d):
    return tokencount.count_tokens(table(s, d, "documents"))


@query
def op9_packing(s, d):
    return packing.digest(table(s, d, "documents"))


@query
def op10_chat_format(s, d):
    turns = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = s.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


@query
def op3_quality_rules(s, d):
    return quality.digest(table(s, d, "documents"))


ORACLE["op3_quality_rules"] = quality.SQL


@query
def op4_secret_scan(s, d):
    return secret_scan.digest(table(s, d, "documents"))


@query
def op8_neighbours(s, d):
    return ann.digest(table(s, d, "embeddings"))


@query
def op5_personal_data(s, d):
    return pii.digest(table(s, d, "documents"))


@query
def op7_jaccard_join(s, d):
    return jaccard.digest(table(s, d, "documents"))


@query
def op11_exact_dedup(s, d):
    return cuckoo.digest(table(s, d, "documents"))


ORACLE["op11_exact_dedup"] = cuckoo.SQL


@query
def op12_hard_negatives(s, d):
    return hardneg.digest(table(s, d, "embeddings"))


ORACLE["op12_hard_negatives"] = hardneg.SQL


@query
def op13_structure_repair(s, d):
    return repair.digest(table(s, d, "conversations"))

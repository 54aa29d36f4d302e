"""Queries on encoded examples and conversations, packed into records of fixed width.

Order is that of a hash of seed and id, cut by its first digit into blocks that are packed by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokenizer
from ..functions.rows import per_row
from ..operators.records import next_fit, next_fit_sql
from .dialect import Dialect, Duck, relational, spark_sql, words
from .registry import query
from .select_queries import CH, EX, rank_key

WIDTH, DUCK, SPARK = 128, Duck(), Dialect()


def sized(d, keys="split"):
    """Examples with their sizes in words: the prompt, and all with the end marker."""
    p = f"({d.size(words(d, 'instruction'))} + {d.size(words(d, chr(99) + 'oalesce(input, ' + chr(39) * 2 + ')'))} + 2)"
    return f"(select {keys}, substr(hk, 1, 1) as block, hk, example_id as id, {p} as prompt, {p} + {d.size(words(d, 'response'))} + 1 as n from (select x.*, {rank_key(d, 'example_id')} as hk from {EX} x where instruction is not null and trim(instruction) <> '' and response is not null and trim(response) <> '') z)"


def turns(d):
    """Turns of the dialogues: a user's line and the assistant's answer, up to the first whose answer can't be whole; the rest of its conversation is dropped."""
    pos = "posexplode(split(text, '\\n')) as (p, l)" if d.spark else "unnest(range(len(string_split(text, chr(10))))) as p, unnest(string_split(text, chr(10))) as l"
    w = d.size(words(d, "l"))
    return f"""(select 'all' as grp, substr(hk, 1, 1) as block, hk || {"lpad(cast(t as string), 6, '0')" if d.spark else "lpad(cast(t as varchar), 6, '0')"} as hk, doc_id * 1000000 + t as id, doc_id, t, prompt, n, lost from (
      select doc_id, t, prompt, n, {rank_key(d, 'doc_id')} as hk, coalesce(max(case when n > {WIDTH} then 1 else 0 end) over (partition by doc_id order by t rows between unbounded preceding and 1 preceding), 0) as lost from (
      select doc_id, t, sum(case when role = 'u' then w else 0 end) + 2 as prompt, sum(w) + 3 as n from (select doc_id, role, w, sum(case when role = 'u' then 1 else 0 end) over (partition by doc_id order by p) as t from (
        select doc_id, p, {w} as w, case when l like 'User:%' then 'u' when l like 'Assistant:%' then 'a' end as role from (select doc_id, {pos} from @documents where text like '%User:%Assistant:%') a) b where role is not null) c where t > 0 group by 1, 2 having count(*) = 2) e) f)"""


def packed(name: str, rows: Callable, keys: list[str], width: int, keep_over: bool, select: str, doc: str) -> None:
    """Register a packing query: ``select`` is over walk, the packed rows, in either engine."""
    plain = rows(DUCK).replace("@", "")

    @query(name, f"with recursive {next_fit_sql(plain, keys, width, keep_over)} {select}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        next_fit(spark_sql(spark, sf, f"select * from {rows(SPARK)} r"), keys, width, keep_over).createOrReplaceTempView("lodestone_walk")
        return spark.sql(select.replace("from walk", "from lodestone_walk"))

    run.__doc__ = doc


_ALL = "{k}, block, id, record, start, kept, state"
_LIVE = "state in ('complete', 'truncated')"
packed("j5_masked_records", lambda d: sized(d), ["split"], WIDTH, True, "select split, block, id as example_id, record, start, kept, state from walk where state <> 'dropped'", "Next-fit records of the examples; longer ones are cut into a record of their own, without end marker.")
packed("j7_complete_records", lambda d: sized(d), ["split"], WIDTH, False, "select split, block, id as example_id, record, start, start + kept as end_, state from walk", "Records of whole examples only; those longer than a record are reported.")
packed("j9_packing_statistics", lambda d: sized(d), ["split"], WIDTH, False, f"""select split, count(*) as records, cast(sum(examples) as bigint) as examples, cast(sum(used) as bigint) as real_tokens, cast(sum({WIDTH} - used) as bigint) as padding_tokens, round(avg(used / {WIDTH}.0e0), 6) as mean_utilization, round(min(used) / {WIDTH}.0e0, 6) as lowest, round(max(used) / {WIDTH}.0e0, 6) as highest
  from (select split, block, record, count(*) as examples, cast(sum(kept) as double) as used from walk where state = 'complete' group by 1, 2, 3) x group by 1""", "Use of the records' tokens by split.")
packed("j15_lineage", lambda d: sized(d), ["split"], WIDTH, False, "select split, count(*) as examples, cast(sum(case when state = 'complete' then 1 else 0 end) as bigint) as located, count(distinct id) as ids, cast(sum(case when state = 'complete' and start + kept <= 128 then 1 else 0 end) as bigint) as within from walk group by 1", "Whether each example has exactly one place in the records.")
packed("i9_operation_view", lambda d: sized(d, "capability, coalesce(difficulty, '') as difficulty"), ["capability", "difficulty"], WIDTH, False, "select capability, difficulty, block, record, count(*) as examples, cast(sum(kept) as bigint) as used from walk where state = 'complete' group by 1, 2, 3, 4", "Records of examples of one capability and difficulty.")
packed("j18_view_checks", lambda d: sized(d, "capability, coalesce(difficulty, '') as difficulty"), ["capability", "difficulty"], WIDTH, False, f"""select capability, difficulty, count(*) as records, cast(sum(case when first <> 0 then 1 else 0 end) as bigint) as not_from_start, cast(sum(case when used <> last then 1 else 0 end) as bigint) as gaps, cast(sum(case when last > {WIDTH} then 1 else 0 end) as bigint) as too_wide, max(record) - min(record) + 1 = count(distinct record) or count(distinct block) > 1 as dense
  from (select capability, difficulty, block, record, min(start) as first, max(start + kept) as last, sum(kept) as used from walk where state = 'complete' group by 1, 2, 3, 4) x group by 1, 2""", "Whether the records of each view are dense, begin at 0, and hold their examples without gaps.")
packed("j6_turn_records", lambda d: f"(select grp, block, hk, id, prompt, n from {turns(d)} t where lost = 0)", ["grp"], WIDTH, True, "select block, cast(floor(id / 1000000) as bigint) as doc_id, cast(id % 1000000 as bigint) as turn, record, start, kept, state from walk", "Turns of the dialogues in records; what follows a cut or dropped turn of a conversation is left out.")
BUDGET = 40
packed("j6_turn_budget", lambda d: f"(select grp, block, hk, id, prompt, n from {turns(d)} t where lost = 0)", ["grp"], WIDTH, True, f"""select block, count(*) as conversations, cast(sum(kept) as bigint) as tokens from (select block, cast(floor(id / 1000000) as bigint) as doc_id, max(record) as last, sum(kept) as kept from walk where {_LIVE} group by 1, 2) x where last < {BUDGET} group by 1""", "Whole conversations that fit into a budget of records of each block.")


def replayed(d, epochs=2):
    """Examples of each replay epoch, in an order of its own."""
    each = " union all ".join(f"select cast({e} as bigint) as epoch, x.*, {rank_key(d, chr(39) + str(e) + chr(39), 'example_id')} as hk from {EX} x where instruction is not null and response is not null" for e in range(epochs))
    p = f"({d.size(words(d, 'instruction'))} + 2)"
    return f"(select epoch, substr(hk, 1, 1) as block, hk, example_id as id, {p} as prompt, {p} + {d.size(words(d, 'response'))} + 1 as n from ({each}) z)"


packed("j8_replay_records", replayed, ["epoch"], WIDTH, False, "select epoch, block, count(distinct record) as records, count(*) as examples, count(distinct id) as ids, cast(sum(kept) as bigint) as real_tokens from walk where state = 'complete' group by 1, 2", "Records of all examples over two replay epochs, each in an order of its own.")


@relational("j2_flattened_dialogues")
def j2(d):
    """Hash of each dialogue with its roles' names and an end marker after each answer."""
    t = d.sub(d.sub("text", r"(?m)^(Assistant:[^\n]*)$", "$1 [EOS]"), r"[ \t]+\n", "\n")
    return f"select doc_id, {d.sha(t)} as sha256, {d.size(d.all('text', '(?m)^Assistant:'))} as answers from @documents where text like '%User:%Assistant:%'"


@relational("j11_shifted_view")
def j11(d):
    """Inputs, targets and target mask of each chunk as sums weighted by place: tokens without the last, without the first, and the mask without the first."""
    n = d.size("token_ids")
    idx = lambda k: "cast(i as int)" if d.spark and not k else "cast(i + 1 as int)" if d.spark else "i" if not k else "i + 1"
    seq = d.seq("1", d.int(f"{n} - 1"))
    total = lambda c, k: d.sum_of(d.map(seq, "i", f"i * cast({d.at(c, idx(k))} as bigint)"))
    return f"select chunk_id, {n} - 1 as length, {total('token_ids', 0)} as inputs, {total('token_ids', 1)} as targets, {total('stored_mask', 1)} as mask from {CH} x where token_ids is not null and stored_mask is not null and {n} >= 2 and {n} = {d.size('stored_mask')}"


@relational("j10_tail_invariants")
def j10_more(d):
    """Chunks by what their masks show: unsupervised start, one supervised stretch at the end, none at all."""
    m = d.join(d.map("stored_mask", "z", "cast(z as varchar(3))"), "")
    return f"with x as (select chunk_id, {m} as m from {CH} c where stored_mask is not null) select {d.like('m', '^0')} as starts_unsupervised, {d.like('m', '^0*1+$')} as one_final_stretch, {d.like('m', '1')} as supervised, {d.like('m', '^[01]*$')} as binary_, count(*) as n from x group by 1, 2, 3, 4"


def _prompt(instruction: str, more: str | None) -> str:
    return f"User: {instruction}" + (f"\n{more}" if more and more.strip() else "") + "\nAssistant:"


@query("j14_stable_boundaries")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Of each capability, examples whose prompt's tokens are the beginning of those of prompt and response together."""
    def run(cap, i, more, r):
        p = _prompt(i, more)
        alone, both = tokenizer.encode(p), tokenizer.encode(f"{p} {r}")
        yield cap, both[: len(alone)] == alone, len(both) - len(alone)

    x = spark_sql(spark, sf, f"select capability, instruction, input, response from {EX} x where instruction is not null and response is not null")
    y = per_row(x, run, "capability string, stable boolean, response_tokens int")
    return y.groupBy("capability").agg(F.count(F.lit(1)).alias("n"), F.count_if("stable").alias("stable"), F.sum("response_tokens").alias("response_tokens"))


EOS = 0


@query("j17_supervised_runs")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    """Token records of the examples: whether each supervised run follows the assistant's header, and how many runs lack the end marker."""
    rows = spark_sql(spark, sf, f"select split, substr(hk, 1, 1) as block, hk, example_id as id, instruction, input, response from (select x.*, {rank_key(SPARK, 'example_id')} as hk from {EX} x where instruction is not null and response is not null) z")

    def ids(split, block, hk, i, ins, more, r):
        p = tokenizer.encode(_prompt(ins, more))
        yield split, block, hk, i, p, tokenizer.encode(" " + r)

    own = per_row(rows, ids, "split string, block string, hk string, id string, p array<int>, r array<int>")
    sizes = own.select("split", "block", "hk", "id", F.size("p").cast("long").alias("prompt"), (F.size("p") + F.size("r") + 1).cast("long").alias("n"))
    at = next_fit(sizes, ["split"], 192).filter("kept > 0")
    x = own.join(at.select("id", "kept", "state"), "id").select("split", "id", "p", F.slice(F.concat("p", "r", F.array(F.lit(EOS))), 1, F.col("kept").cast("int")).alias("t"), "state")

    def check(split, i, p, t, state):
        text = tokenizer.encoder().decode(t[: len(p)])
        yield split, text.endswith("Assistant:"), len(t) > len(p) and t[-1] == EOS

    y = per_row(x, check, "split string, header boolean, ended boolean")
    return y.groupBy("split").agg(F.count(F.lit(1)).alias("runs"), F.count_if("header").alias("with_header"), F.count_if(~F.col("ended")).alias("without_end"))

"""Search plans: fixed families, a product of phrases and themes, follow-ups from evidence, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify, squeeze
from ..functions.venues import domain_filter, one_of, repository, venue_year
from ..operators.catalog import dedupe_first
from ..operators.queue import round_robin, scoring_text
from ..schemas import PLAN
from ..values import PLAN_PHRASES, PLAN_THEMES, STAGE_ORDER

# Queries of the static families; stage, platform, content size.
FAMILIES = {
    ("seed", "web", "high"): [
        '"accepted to" "AAAI 2026" "official code"', '"accepted to" "ACL 2026" "official code"', '"accepted to" "ICLR 2026" "project page"', '"accepted to" "CVPR 2026" "multimodal"', '"accepted at" "AAAI 2026" "LLM"', '"accepted at" "ACL 2026" "VLM"',
        '"to appear at" "ICLR 2026" "multimodal"', '"main conference" "ACL 2026" "paper"', '"AAAI 2026" "our paper" "large language model"', '"ACL 2026" "our paper" "multimodal"', '"ICLR 2026" "our paper" "agent"', '"CVPR 2026" "our paper" "3D Gaussian Splatting"',
    ],
    ("repository", "github", "high"): [
        'site:github.com "AAAI 2026" "official code" "LLM"', 'site:github.com "ACL 2026" "accepted" "multimodal"', 'site:github.com "ICLR 2026" "official repo" "agent"', 'site:github.com "CVPR 2026" "project page" "3D"', 'site:github.com "EMNLP 2026" "paper" "VLM"',
        'site:github.com "NeurIPS 2026" "paper" "VLA"', 'site:github.com "[AAAI 2026]" "This is the code repository for our paper"', 'site:github.com "[ACL 2026]" "official implementation"', 'site:github.com "[ICLR 2026]" "accepted"', 'site:github.com "2026" "This work has been accepted" "multimodal"',
    ],
    ("paper-index", "arxiv", "high"): [
        'arxiv "accepted to" "2026" "large language model"', 'arxiv "project page" "2026" "vision language model"', 'arxiv "3D Gaussian Splatting" "VLM" "2026"', 'arxiv "vision language action" VLA "2026"', 'arxiv "multimodal benchmark" "2026" "LLM"',
        'arxiv "agent" "reasoning" "accepted" "2026"', 'site:arxiv.org/abs "2026" "LLM" "accepted"', 'site:arxiv.org/abs "2026" "multimodal" "project page"', 'site:openreview.net/forum "ICLR 2026" "LLM"', 'site:openreview.net/forum "2026" "vision language"',
    ],
    ("homepage", "homepage", "high"): [
        'site:github.io "accepted to" "2026" "LLM"', 'site:github.io "paper" "multimodal" "2026"', 'site:github.io "project page" "vision-language" "2026"', 'site:github.io "This work has been accepted" "2026"', 'site:github.io "official code" "AAAI 2026"', 'site:github.io "official code" "ACL 2026"',
        'site:edu "accepted to" "2026" "large language model"', 'site:edu "our paper" "2026" "multimodal"', 'site:edu "publication" "AAAI 2026" "LLM"', 'site:edu "news" "accepted to ACL 2026"', 'site:edu "publications" "ICLR 2026" "multimodal"',
    ],
    ("chinese", "web", "medium"): ["论文录用 顶会 大模型 AAAI ACL ICLR 2026", "新论文 多模态 CVPR ICLR 2026", "新论文 智能体 具身 2026", "小红书 论文录用 顶会 大模型 2026", "小红书 新论文 VLM MLLM VLA 2026"],
    ("broad", "web", "medium"): [
        '"2026" "official repo" "multimodal"', '"2026" "project page" "large language model"', '"2026" "paper" "vision language action"', '"2026" "paper" "3D Gaussian Splatting"', '"2026" "paper" "multimodal RAG"', '"2026" "paper" "reasoning" "RL"',
        '"AAAI 2026" "GitHub" "large language models"', '"ACL 2026" "GitHub" "multimodal"', '"ICLR 2026" "GitHub" "agent"', '"CVPR 2026" "project" "3DGS"',
    ],
}
ENGINE, RECENCY = "search_pro", "oneMonth"
# What plans may ask for.
RECENCIES, SIZES = ["noLimit", "oneDay", "oneWeek", "oneMonth", "oneYear"], ["low", "medium", "high"]


def static_plans(spark: SparkSession) -> DataFrame:
    """(pos, plan columns) of all families in their order; labels are numbered from 1."""
    rows = [(stage, platform, size, i, q) for (stage, platform, size), queries in FAMILIES.items() for i, q in enumerate(queries, 1)]
    fixed = spark.createDataFrame(rows, "stage string, platform string, contentSize string, i int, query string").withColumn("label", F.concat_ws("-", "stage", "i"))
    here = F.when(F.col("query").contains("openreview"), "openreview").when(F.col("query").contains("小红书"), "xiaohongshu").otherwise(F.col("platform"))
    fixed = fixed.withColumn("platform", here)
    domains = {"github": "github.com", "openreview": "openreview.net", "arxiv": "arxiv.org", "xiaohongshu": "xiaohongshu.com", "x": "x.com"}
    domain = F.create_map(*[F.lit(v) for kv in domains.items() for v in kv])
    both = fixed.select("stage", "platform", "contentSize", "i", "query", "label").unionByName(announcement_plans(spark))
    place = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    out = both.withColumn("pos", (place * 1000 + F.col("i")).cast("long")).withColumn("domainFilter", F.try_element_at(domain, F.col("platform")))
    defaults = {"recencyFilter": F.lit(RECENCY), "searchEngine": F.lit(ENGINE), "intent": F.lit(""), "parentUrl": F.lit("")}
    return dedupe_plans(out.withColumns(defaults).select("pos", *PLAN.names))


def announcement_plans(spark: SparkSession, phrases: list[str] = PLAN_PHRASES, themes: list[str] = PLAN_THEMES) -> DataFrame:
    """Every phrase with every theme: two short fixed lists, exploded."""
    both = spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in phrases])).alias("p", "phrase")).select("*", F.posexplode(F.array(*[F.lit(t) for t in themes])).alias("t", "theme"))
    label = F.concat_ws("-", F.lit("social"), slugify(F.col("phrase"), "query", 32), F.col("t") + 1)
    return both.select(F.lit("social").alias("stage"), F.lit("x").alias("platform"), F.lit("medium").alias("contentSize"), (F.col("p") * len(themes) + F.col("t") + 1).alias("i"), F.concat_ws(" ", "phrase", "theme", F.lit("2026")).alias("query"), label.alias("label"))


def plan_key() -> Column:
    """Plans with one engine, domain, recency and query are one."""
    return F.concat_ws(":", F.lower(squeeze(F.coalesce("searchEngine", F.lit(ENGINE)))), F.coalesce(domain_filter(F.col("domainFilter")), F.lit("undefined")), one_of(F.col("recencyFilter"), RECENCIES, RECENCY), scoring_text(F.col("query")))


def dedupe_plans(plans: DataFrame) -> DataFrame:
    keyed = plans.where(scoring_text(F.col("query")) != "").withColumn("_k", plan_key())
    return dedupe_first(keyed, ["_k"], "pos").drop("_k")


def select_plans(plans: DataFrame, most: int, strategy: str = "balanced") -> DataFrame:
    """The first ones, or turns over the stages so that none takes the whole budget, which is never exceeded."""
    return plans.orderBy("pos").limit(most) if strategy == "prefix" else round_robin(plans, "stage", "pos", most)


def follow_up_plans(evidence: DataFrame) -> DataFrame:
    """(pos, query, platform, intent, parentUrl) from the address and the venue-year of evidence (pos, url, text)."""
    repo = repository(F.col("url"))
    venue = venue_year(F.col("text"))
    ask = lambda query, platform, intent: F.struct(query.alias("query"), F.lit(platform).alias("platform"), F.lit(intent).alias("intent"))
    name = repo["name"]
    of_repo = F.array(ask(F.concat(F.lit('"'), repo["owner"], F.lit("/"), name, F.lit('" paper accepted 2026')), "web", "trace repository"), ask(F.concat(F.lit('site:x.com "'), name, F.lit('" paper')), "x", "find announcement"))
    of_venue = F.array(ask(F.concat(F.lit('"'), venue, F.lit('" "paper" "official code"')), "web", "expand venue"), ask(F.concat(F.lit('site:github.com "'), venue, F.lit('" "paper"')), "github", "expand venue"))
    none = F.array().cast("array<struct<query:string,platform:string,intent:string>>")
    plans = F.concat(F.when(repo.isNotNull(), of_repo).otherwise(none), F.when(venue != "", of_venue).otherwise(none))
    rows = evidence.select("pos", F.col("url").alias("parentUrl"), F.posexplode(plans).alias("i", "p"))
    return rows.select((F.col("pos") * 10 + F.col("i")).alias("pos"), "p.query", "p.platform", "p.intent", "parentUrl")

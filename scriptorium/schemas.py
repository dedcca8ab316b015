"""Schemas of stored records; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .values import INTRO_KEYS


def _struct(text: str) -> StructType:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "d": DoubleType(), "b": BooleanType(), "t": TimestampType(), "S": ArrayType(StringType()), "F": ArrayType(FloatType())}
    return StructType([StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in text.split())])


EVIDENCE = _struct("platform:s url:s title:s author:s snippet:s readerTitle:s readerExcerpt:s publishDate:s query:s")
GUIDE = StructType([StructField(k, StringType()) for k in INTRO_KEYS])
PAPER = StructType([
    *_struct("id:s title:s titleZh:s hookZh:s venue:s year:i track:s primaryCategory:s categories:S keywords:S authors:S openreviewUrl:s pdfUrl:s tldr:s abstract:s"),
    StructField("introZh", GUIDE),
    *_struct("aliases:S source:s sourceId:s guideStatus:s sourceType:s acceptanceStatus:s acceptedVenue:s acceptedYear:i discoveredAt:t lastCheckedAt:t evidenceCount:i platforms:S"),
])
ENTRY = StructType([
    *_struct("id:s title:s titleZh:s summary:s abstract:s reason:s hookZh:s enrichmentStatus:s metadataSource:s primaryUrl:s canonicalUrl:s pdfUrl:s sourceId:s year:i status:s confidence:d"),
    *_struct("acceptedVenue:s acceptedYear:i discoveredAt:s updatedAt:s lastCheckedAt:s authors:S keywords:S titleAliases:S aliases:S platforms:S"),
    StructField("evidence", ArrayType(EVIDENCE)), StructField("evidenceCount", IntegerType()), StructField("acceptanceEvidence", _struct("confidence:d url:s title:s venue:s snippet:s")),
])
SHARD_REF = _struct("key:s venue:s year:i path:s count:l")
CHUNK = _struct("key:s venue:s year:i part:i offset:l count:l dimensions:i file:s bytes:l fingerprint:s")
VECTOR = _struct("id:s shard_key:s part:i pos:l embedding:F")
PLAN = _struct("label:s query:s stage:s platform:s domainFilter:s recencyFilter:s searchEngine:s contentSize:s intent:s parentUrl:s")
QUERY_TRACE = _struct("label:s query:s stage:s phase:s platform:s rawResultCount:i resultCount:i rejectedCount:i")
HYBRID_HIT = _struct("id:s score:d exactTitleMatch:b matchedSignals:S semanticScore:d lexicalScore:d rankScore:d")

"""Record shapes."""

from pyspark.sql import types as T

_S = T.StringType()

# A feed record, and where it stood in its feed.
FEED_FIELDS = ("title", "url", "source", "author", "publishedAt")
FEED = T.StructType([T.StructField("pos", T.LongType())] + [T.StructField(c, _S) for c in FEED_FIELDS])

# A landed API response.
API_ARTICLE = T.StructType([
    T.StructField("source", T.StructType([T.StructField("name", _S)])),
    T.StructField("author", _S),
    T.StructField("title", _S),
    T.StructField("url", _S),
    T.StructField("publishedAt", _S),
])
API_RESPONSE = T.StructType([
    T.StructField("status", _S),
    T.StructField("articles", T.ArrayType(API_ARTICLE)),
])

# A landed RSS item.
RSS_ITEM = T.StructType([
    T.StructField("title", _S),
    T.StructField("link", _S),
    T.StructField("source", T.StructType([T.StructField("_VALUE", _S), T.StructField("_url", _S)])),
    T.StructField("author", _S),
    T.StructField("pubDate", _S),
])

DIGEST_FIELDS = (
    "title", "url", "source", "author", "publishedAt", "content", "summary", "sentiment", "score",
)
DIGEST = T.StructType(
    [T.StructField(c, T.DoubleType() if c == "score" else _S) for c in DIGEST_FIELDS]
)

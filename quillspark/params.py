"""Parameters that define the meaning of a result."""

# Chunking
CHUNK_SIZE = 1200
CHUNK_OVERLAP = 200
MIN_CHUNK_CHARS = 15
PAGE_BATCH = 5
DEFAULT_PATH = "通用正文"
DEFAULT_CLAUSE = "明细条款"
TOC_PATH_MARK = "目 次"
TOC_TEXT_MARK = "........"
ALLOWED_EXTENSIONS = ("pdf", "txt", "docx", "md")

# Retrieval
DENSE_K = 40
SPARSE_K = 20
RERANK_TOP_N = 10
SCORE_THRESHOLD = 0.05
MISSING_SCORE = -100.0
DEGRADED_K = 5
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
CACHE_THRESHOLD = 0.96
FALLBACK_ANSWER = (
    "抱歉，根据目前的知识库，未找到与您描述完全匹配的交通法规条款。"
    "建议您提供更详细的关键词，或咨询当地交管部门。"
)
NO_GRAPH_CONTEXT = "暂无图谱逻辑关联"

# Sessions
HISTORY_TTL_SECONDS = 3600
HISTORY_READ = 8
HISTORY_STORED = 16
TITLE_CHARS = 15
USER_LABEL = "用户"
AI_LABEL = "助手"
DEFAULT_TITLE = "新对话"

# Topics
MAX_CLUSTERS = 8
TOPIC_MIN_CHARS = 5
TOPIC_MIN_SAMPLES = 10
TOPIC_SEED = 42
TOPIC_N_INIT = 10
TOPIC_REPRESENTATIVES = 3
TOPIC_PROMPT_MESSAGES = 10
TOPIC_DEFAULT_NAME = "未分类主题"
TOPIC_DEFAULT_KEYWORDS = ("交通",)
TOPIC_FAILED_NAME = "热点话题 "
TOPIC_FAILED_KEYWORDS = ("点击查看详情",)

# Graph
GRAPH_MIN_CHARS = 20
GRAPH_SAMPLE = 15

# Quiz
QUIZ_COUNT = 10
QUIZ_DOCS = 3
QUIZ_MIN_CHARS = 100
QUIZ_MIN_DIFFICULTY = 3
QUIZ_MAX_DIFFICULTY = 5
QUIZ_LETTERS = ("A", "B", "C", "D")
QUIZ_POINTS = 10

# Dashboard
TOKENS_PER_CHAR = 1.5
PRICE_PER_1K = 0.002

# Embedding requests
EMBED_BATCH = 15
EMBED_TRIES = 3

# Preference defaults
DEFAULT_PREFS = {
    "llm_model": "deepseek-chat",
    "llm_key": "",
    "embed_model": "text-embedding-v4",
    "embed_key": "",
    "vision_model": "qwen-vl-max",
    "vision_key": "",
}

# Every character that counts as white space at the ends of a text
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Patterns (Java regex syntax)
CONTROL_CHARS = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"
UNICODE_SPACE = r"(?U)\s+"
BROKEN_LINE = r"([^.。：:；;!！?？>])\n+([^\n#*-])"
HEADING = r"^[ \t]*(#{1,4}) ([^\n]*)"
FENCE = r"^[ \t]*(```|~~~)([^\n]*)"
CLAUSE = r"第[一-龥\p{Nd}]+条"
MARKUP_OPEN = r"(?i)<\|?DSML\|?.*?>"
MARKUP_CLOSE = r"(?i)</\|?DSML\|?.*?>"
OPTION_PREFIX = r"(?U)^[A-D][.、:：\s]+"
NEARBY = r"(.+?)(附近|周边)(?:的)?(.+)"
CODE_FENCE = r"```(?:json)?"
JSON_ARRAY = r"(?s)\[.*\]"
JSON_OBJECT = r"(?s)\{.*\}"
CITATION = r"\[资料(\p{Nd}+)\]"
SPEECH_MARKS = r"[#*`>]"
SPEECH_TAGS = r"\[(?:依据|资料)\p{Nd}+\]"
TOKEN = r"[\p{L}\p{N}&&[^\p{IsHan}]]+|\p{IsHan}"

"""Results only match if these are exactly as given here."""

# --- domains -----------------------------------------------------------------
ARTICLE_STATUSES = ["candidate", "accepted", "rejected", "low_confidence", "skipped_out_of_range"]
DECISIONS = ["accept", "reject", "low_confidence"]
DECISION_STATUS = {"accept": "accepted", "reject": "rejected", "low_confidence": "low_confidence"}
CONTENT_TYPES = [
    "technical_article",
    "engineering_case",
    "research_article",
    "research_reflection",
    "learning_path",
    "personal_reflection",
    "career_experience",
    "tooling_note",
]
CONTENT_TYPE_LABELS = {
    "technical_article": "技术文章",
    "engineering_case": "工程实践",
    "research_article": "科研议题",
    "research_reflection": "科研思考",
    "learning_path": "学习路线",
    "personal_reflection": "个人心得",
    "career_experience": "职业经验",
    "tooling_note": "工具笔记",
}
FEED_TYPES = ["direct", "rsshub", "sitemap", "listing"]
SOURCE_DISPLAYS = ["default", "compact", "featured"]
ACTIVE_QUEUE_STATUSES = ["queued", "running"]
SORT_COLUMNS = ["updated_at", "created_at", "collected_at", "published_at", "retry_count"]

# --- limits ------------------------------------------------------------------
MAX_CONTENT_BYTES = 2_097_152
EVALUATOR_INPUT_CHARS = 50_000
MAX_SITEMAP_DEPTH = 3
MAX_SITEMAP_FILES = 32
MAX_RETRY = 3
MAX_ATTEMPTS = 3
MAX_PAGE_SIZE = 200
SLUG_LENGTH = 96

# --- stored messages ---------------------------------------------------------
REASON_TAG_OUTSIDE_VOCABULARY = "AI 评估将词库外标签放入 tags"
REASON_SUGGESTED_TAG = "AI 评估输出 suggested_tags 新标签建议"
DESCRIPTION_APPROVED_TAG = "由 AI 标签候选审核通过创建"
DESCRIPTION_BOOTSTRAP_TAG = "历史评估标签迁移导入"
ERROR_OUT_OF_RANGE = "published_at is outside requested range"
ERROR_EMPTY_CONTENT = "empty markdown"
ERROR_NO_FETCH = "latest successful fetch not found"
VOCABULARY_HEADING = (
    "\n\n## 当前正式标签词库\n\n"
    "只能从以下正式标签中选择 `tags`。如果没有合适标签，"
    "`tags` 仍需至少选择一个最接近的正式标签，并在 `suggested_tags` "
    "中提出希望新增的标签。\n\n"
)
FEW_SHOT_HEADING = "\n\n## Few-shot JSON examples\n\n"
RETRY_INTRO = "上一次输出无法解析或不符合 schema。\n解析/校验错误：\n"
RETRY_PREVIOUS = "上一次原始输出：\n"
RETRY_OUTRO = (
    "请基于原始文章内容重新输出一个合法 JSON 对象，"
    "不要输出 Markdown 代码块或解释文字。"
)
CRAWLER_FEED_ENTRY = "feed-entry"
FALLBACK_TARGET = "crawler4ai"
ORIGINAL_LINK_PREFIX = "原文："
SOURCE_BLOCK_TITLE = "来源信息"
SOURCE_BLOCK_LABELS = ["来源", "原文", "原文时间", "抓取时间"]
UNKNOWN_TIME = "未知"

# --- publication-time markers, in order of precedence -------------------------
META_DATE_KEYS = [
    ("property", "article:published_time"),
    ("property", "article:modified_time"),
    ("property", "og:updated_time"),
    ("name", "date"),
    ("name", "pubdate"),
    ("name", "publishdate"),
    ("name", "timestamp"),
    ("name", "DC.date.issued"),
    ("itemprop", "datePublished"),
    ("itemprop", "dateModified"),
]
JSON_LD_DATE_KEYS = ["datePublished", "dateModified", "dateCreated"]
SCRIPT_DATE_KEYS = ["datePublished", "dateModified", "dateCreated", "publishedOn", "publishedAt"]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0"]

# --- public standards ---------------------------------------------------------
# Characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ZONE_OFFSETS = {
    "AST": "-04:00",
    "ADT": "-03:00",
    "EST": "-05:00",
    "EDT": "-04:00",
    "CST": "-06:00",
    "CDT": "-05:00",
    "MST": "-07:00",
    "MDT": "-06:00",
    "PST": "-08:00",
    "PDT": "-07:00",
}

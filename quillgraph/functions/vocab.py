"""Word lists, patterns and formats that decide results.

Everything here is plain data.  Patterns are Java regular expressions.
"""

# --- fixed values: whitespace and line breaks as Python's str methods see them ---
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# the look-ahead on one plain range lets the matcher skip printable ASCII cheaply
LINE_BREAK = r"(?=[^ -~])(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029])"
WS_RUN = rf"(?=[^!-~])(?: (?=[^!-~])[{WS_CLASS}]+|(?! )[{WS_CLASS}]+)"

# --- fixed values: categories and their keywords ---
CATEGORIES = [
    "tech_manual", "business_sop", "company_intro",
    "parameter", "process", "project_code", "general",
]
TECH_KEYWORDS = [
    "api", "sdk", "python", "java", "cpp", "安装", "部署", "代码", "参数", "模型", "llm", "cuda",
    "故障", "调试", "配置", "接口", "版本", "依赖", "command", "linux", "windows",
]
BUSINESS_KEYWORDS = [
    "sop", "流程", "制度", "审批", "业务", "运营", "客服", "销售", "采购", "培训", "规范", "手册",
]
FOLLOWUP_MARKERS = ["它", "这个", "那个", "其", "这", "那", "上面", "前面", "刚才", "上一条"]

# --- fixed values: query tokens ---
QUERY_TOKEN = r"[A-Za-z0-9_.:/\\-]{2,}|[\u4e00-\u9fff]{2,}"

# --- fixed values: Markdown patterns ---
PAGE_MARKER = rf"(?i)^<!--[{WS_CLASS}]*page:[{WS_CLASS}]*([0-9]{{1,18}})[{WS_CLASS}]*-->$"
PAGE_NUMBER = r"^[0-9]{1,18}$"
HEADING = rf"^(#{{1,6}})[{WS_CLASS}]+(.+?)[{WS_CLASS}]*#*$"
IMAGE = r'!\[([^\]]*)\]\(([^)' + WS_CLASS + r']+)(?:[' + WS_CLASS + r']+"[^"]*")?\)'
LINK = r'\[([^\]]+)\]\(([^)' + WS_CLASS + r']+)(?:[' + WS_CLASS + r']+"[^"]*")?\)'
RICH_TAG = r"(?i)<(table|img|figure|div|p|ul|ol|li|br)[^>]*>"
TABLE_SEPARATOR = (
    rf"^[{WS_CLASS}]*\|?(?:[{WS_CLASS}]*:?-{{3,}}:?[{WS_CLASS}]*\|)+"
    rf"[{WS_CLASS}]*(?:[{WS_CLASS}]*:?-{{3,}}:?[{WS_CLASS}]*)?\|?[{WS_CLASS}]*$"
)
HTML_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
HTML_CELL = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"
HTML_TAG = r"<[^>]+>"
LIST_LINE = (
    rf"(?i)^[{WS_CLASS}]*(?:[-*+][{WS_CLASS}]+|[0-9]+[.)][{WS_CLASS}]+"
    rf"|第[{WS_CLASS}]*[0-9]+[{WS_CLASS}]*步[:：]?[{WS_CLASS}]+"
    rf"|步骤[{WS_CLASS}]*[0-9]+[:：]?[{WS_CLASS}]+"
    rf"|step[{WS_CLASS}]*[0-9]+[:：]?[{WS_CLASS}]+)"
)
STEP_MARKER = rf"(?i)第[{WS_CLASS}]*[0-9]+[{WS_CLASS}]*步|步骤[{WS_CLASS}]*[0-9]+|step[{WS_CLASS}]*[0-9]+"
STEP_COUNT = (
    rf"(?im)(?d)^[{WS_CLASS}]*[0-9]+[.)][{WS_CLASS}]+"
    rf"|第[{WS_CLASS}]*[0-9]+[{WS_CLASS}]*步|步骤[{WS_CLASS}]*[0-9]+|step[{WS_CLASS}]*[0-9]+"
)
PARAMETER_HINT = r"(?i)参数|配置|默认|单位|说明|含义|取值|名称|value|default|parameter|option"
CONTENTS_TITLE = (
    rf"(?i)^(目录|目录导航|table[{WS_CLASS}]+of[{WS_CLASS}]+contents?|contents?|index|索引)$"
)
SPLIT_SEPARATORS = "\n。；，.;, "
CJK_GAP = r"(?<=[\u4e00-\u9fff\u3400-\u4dbf])[ \t]+(?=[\u4e00-\u9fff\u3400-\u4dbf])"
RADICALS_FROM = "\u2ec6\u2ed4\u3b35"
RADICALS_TO = "\u89d2\u95e8\u80f6"

# --- fixed values: block types ---
PASSTHROUGH_TYPES = ["image", "table", "parameter_table", "code"]
MERGEABLE_TYPES = ["term", "text"]

# --- fixed values: description texts ---
UNNAMED_SECTION = "未命名章节"
DEFAULT_TERM = "术语"
DEFAULT_TUTORIAL = "操作步骤"

# --- fixed values: chunking defaults ---
MAX_CHARS = 1800
OVERLAP_CHARS = 240
MIN_SECTION_CHARS = 80
MICRO_CHUNK_CHARS = 100
IMAGE_CONTEXT_LINES = 2

# --- fixed values: review and answer texts ---
NO_SUMMARY = "已绑定视频片段"
NOTE_PREFIX = "备注: "

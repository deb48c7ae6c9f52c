"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a constant of the translation application we
match: limits, model ids, language names, user-facing messages, message
formats and timing parameters. They are stated once, here, in their natural
order, and imported everywhere else.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: limits and generation budget
# ---------------------------------------------------------------------------
MAX_CHARS = 12000                 # trimmed code points per request: interactive limit, reported
CHUNK_TOKENS = 420                # content token ids per chunk
MODEL_INPUT_CAP = 512             # encoder truncation length
OUTPUT_CAP = 512                  # generation cap: min(512, max(32, 4n + 16))
OUTPUT_FLOOR = 32
BEAMS = 4
REPEAT_MIN = 3                    # repetition collapse: minimum repeats
REPLY_BODY_CAP = 4 * 1024 * 1024  # JSON reply body, bytes
SSE_LINE_CAP = 4 * 1024 * 1024    # one event-stream line, bytes
ERROR_BYTES = 500                 # HTTP error text cut, bytes
LLM_TIMEOUT_S = 120

# ---------------------------------------------------------------------------
# FIXED VALUES: models
# ---------------------------------------------------------------------------
DEFAULT_LOCAL_MODEL = "Helsinki-NLP/opus-mt-en-zh"
DEFAULT_NLLB_MODEL = "facebook/nllb-200-distilled-600M"

# (id, name, description, size, is_default)
MODELS = [
    (DEFAULT_LOCAL_MODEL, "OPUS-MT 英中", "轻量、快速，专用于英语翻译成中文", "约 1.2 GB", True),
    (DEFAULT_NLLB_MODEL, "Meta NLLB-200", "支持 200 种语言，适合多语言互译", "约 2.5 GB", False),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: languages (code, display name used in prompts, NLLB code)
# ---------------------------------------------------------------------------
LANGUAGES = [
    ("en", "英语", "eng_Latn"),
    ("zh", "简体中文", "zho_Hans"),
    ("ja", "日语", "jpn_Jpan"),
    ("ko", "韩语", "kor_Hang"),
    ("fr", "法语", "fra_Latn"),
    ("de", "德语", "deu_Latn"),
    ("es", "西班牙语", "spa_Latn"),
    ("ru", "俄语", "rus_Cyrl"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: settings defaults
# ---------------------------------------------------------------------------
DEFAULT_PROVIDER = "local"
DEFAULT_SOURCE = "en"
DEFAULT_TARGET = "zh"

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = "你是专业翻译引擎。只输出译文，不解释、不加引号，并保持原文的段落、格式、语气和专有名词。"
USER_PROMPT_HEAD = "将以下"       # 将以下{source}文本翻译为{target}：\n\n{text}
USER_PROMPT_MID = "文本翻译为"
USER_PROMPT_TAIL = "：\n\n"
COMPLETIONS_PATH = "/chat/completions"
V1_PATH = "/v1"

# ---------------------------------------------------------------------------
# FIXED VALUES: labels and messages
# ---------------------------------------------------------------------------
DIRECT_PROVIDER = "direct"
DIRECT_MODEL = "原文"
PROVIDER_LABEL_LOCAL = "本地"
PROVIDER_LABEL_LLM = "LLM"
PROVIDER_LABEL_OTHER = "原文"

MSG_EMPTY = "请输入要翻译的文本"
MSG_TOO_LONG = "单次翻译最多支持 12000 个字符"
MSG_LLM_NO_URL = "请先配置 LLM Base URL"
MSG_LLM_NO_MODEL = "请先配置 LLM 模型名称"
MSG_PAIR_UNSUPPORTED = "Helsinki 英中模型仅支持英语 → 中文；其他语言请选择 NLLB-200 或 LLM"
MSG_MODEL_NOT_READY = "所选本地模型尚未下载，请先到模型管理中下载"
MSG_MODEL_CACHE_BROKEN = "本地模型缓存不完整或已损坏，请在模型管理中重新下载该模型"
MSG_LANG_UNMAPPED = "当前 NLLB 界面语言映射不受支持"
MSG_NO_TRANSLATION = "LLM 没有返回译文"
MSG_PARSE_ERROR = "无法解析 LLM 响应"
MSG_STREAM_PARSE_ERROR = "无法解析 LLM 流式响应"
MSG_STREAM_ERROR = "LLM 流式响应错误: "
MSG_UNKNOWN_ERROR = "未知错误"
MSG_HTTP_ERROR_HEAD = "LLM 返回错误 ("  # LLM 返回错误 ({status}): {message}
MSG_HTTP_ERROR_MID = "): "
MSG_UNKNOWN_FAILURE = "发生未知错误"
MSG_DOWNLOAD_FAILED = "模型下载失败: "

# progress messages
PROGRESS_NAMED_HEAD = "正在下载 "        # 正在下载 {name} · 当前文件 {p}%
PROGRESS_BARE_HEAD = "正在下载模型文件"  # 正在下载模型文件 · 当前文件 {p}%
PROGRESS_FILE_MID = " · 当前文件 "
PROGRESS_MESSAGE_CHARS = 180
PROGRESS_NAME_CHARS = 80
DOWNLOAD_CONNECTING = "正在连接 Hugging Face…"
DOWNLOAD_READY = "模型已就绪"
ELLIPSIS = "…"

# ---------------------------------------------------------------------------
# FIXED VALUES: patterns
# ---------------------------------------------------------------------------
# Go strings.TrimSpace set (Unicode White_Space), written for both Java and RE2.
WHITE_SPACE_CLASS = (
    r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NOT_WHITE_SPACE = "[^" + WHITE_SPACE_CLASS[1:]
ANSI_ESCAPE = r"\x1b\[[0-?]*[ -/]*[@-~]"
# (?d): Java '.' then excludes only '\n', like Go's '.'.
PROGRESS_NAMED = r"(?d)^(.+?):\s*(\d{1,3})%\|"
PROGRESS_BARE = r"(?:^|\s)(\d{1,3})%"
PARAGRAPH_PARTS = r"(\n+|[^\n]+)"
# the program's log: time in front of each record, keys of its lines, keys whose value takes the rest
LOG_PREFIX = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{6}) "
LOG_TIME = "yyyy/MM/dd HH:mm:ss.SSSSSS"
LOG_KEYS = ("provider", "source", "target", "characters", "model", "local_model", "clipboard", "quick_open", "shortcut",
            "close_to_tray", "always_on_top", "progress", "base", "python", "log")
LOG_FREE_KEYS = ("error", "message", "output")
ERROR_PREFIX = r"(?i)^Error:\s*"

# ---------------------------------------------------------------------------
# FIXED VALUES: timing (milliseconds)
# ---------------------------------------------------------------------------
DELTA_INTERVAL_MS = 35
POLL_INTERVAL_MS = 180
TAP_MIN_GAP_MS = 40
TAP_MAX_GAP_MS = 500
TAP_MAX_HOLD_MS = 500
TAP_REFRACTORY_MS = 250

# ---------------------------------------------------------------------------
# OWN VALUES: messages of rows that the application has no message for; segments that
# begin so make the test double fail
# ---------------------------------------------------------------------------
MSG_NO_REPLY_STATUS = "LLM 回复没有状态码"
MSG_BAD_REQUEST = "无法解析请求"
MSG_SETTINGS_ERROR = "设置文件无法解析"
MSG_SETTINGS_CONFLICT = "同一租户有不同的设置文件"
MSG_MISSING_TRANSLATION = "模型没有返回这一段的译文"
EPOCH_2026_US = 1_767_225_600_000_000
PSEUDO_REFUSES = "[refuse] "
MSG_PSEUDO_REFUSED = "the test double refuses this segment"

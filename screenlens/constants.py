"""Fixed values.

Everything in this module is a value that must stay exactly as written for
results to agree with the original screening application: label names,
token lists, thresholds, template sentences, boost weights.  They are data,
kept together and in their natural order; the logic that uses them lives in
the operator modules.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: label dictionary (code -> conclusion text)
# ---------------------------------------------------------------------------
LABELS = {
    0: "其他疾病或异常",
    1: "目前未见异常",
    2: "复查",
    3: "职业禁忌证",
    4: "疑似职业病",
}
THREE_CLASS = (0, 1, 2)
EXCLUDED_CODES = (3, 4)          # left to the rules, not to the classifiers
REMAP_CODES = {5: 2}             # label 5 is folded into "复查"

# ---------------------------------------------------------------------------
# FIXED VALUES: column-name keywords and column lists of the wide schema
# ---------------------------------------------------------------------------
MARKER_KEYWORDS = ["标记"]
UNIT_KEYWORDS = ["单位"]
HAZARD_PREFIX = "危害因素_"
OTHER_REMOVED_COLUMNS = ["体检危害因素24", "所属部门20"]
PRIVACY_COLUMNS = [
    "姓名0", "体检编号1", "监测类型18", "在岗状态19", "所属部门20", "体检危害因素24", "接触危害因素25",
    "起止日期26", "部门车间28", "诊断日期31", "起止日期35", "主检建议1528",
    "职业禁忌证名称1529", "疑似职业病名称1530", "体检机构1531", "体检日期1532", "报告出具日期1533",
    "报告日期1534",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: value normalisation ("normal" spellings -> 无)
# ---------------------------------------------------------------------------
COMMON_NORMAL_VALUES = ["未见异常", "无特殊情况", "未见明显异常", "目前无不适症状", "正常", "无"]
SPECIFIC_NORMAL_VALUES = {
    "肌力结果350": ["正常（Ⅴ级）", "5级"],
    "肌张力结果356": ["正常肌张力"],
}
NORMAL_TARGET = "无"

# ---------------------------------------------------------------------------
# FIXED VALUES: fill rules, binary negation tokens, duration pattern
# ---------------------------------------------------------------------------
FILL_RULES = {"家族史42": "无", "其他症状46": "无", "个人史43": "无", "放射线种类41": "无", "治疗经过33": "已成"}
BINARY_FEATURES = ["家族史42", "个人史43", "其他44", "自觉症状45", "其他症状46", "既往病史疾病名称30", "防护措施29"]
NEGATION_TOKENS_TRAIN = ["无", "未", "不"]
DURATION_FIELDS = ["总工龄22", "接害工龄23"]
MARKER_FILL = "合格"
TOP_HAZARDS = 20

# ---------------------------------------------------------------------------
# FIXED VALUES: null spellings, "looks normal" tokens, abnormal keywords
# ---------------------------------------------------------------------------
EMPTY_SPELLINGS = ["", "nan", "None"]
NORMAL_TOKENS = ["正常", "未见异常", "合格", "阴性", "无明显异常", "未见明显异常"]
NEGATED_NORMAL = ["不正常", "不合格"]
ABNORMAL_KEYWORDS = ["异常", "增多", "增粗", "不齐", "阻塞", "拘束", "降低", "不合格", "结节", "斑片", "改变", "损害"]
OCCUPATIONAL_SIGNAL_TOKENS = ["噪声", "粉尘", "苯", "高温", "射线"]

# ---------------------------------------------------------------------------
# FIXED VALUES: highlight thresholds and texts (in check order)
# ---------------------------------------------------------------------------
SBP_HIGH = 140.0
DBP_HIGH = 90.0
GLUCOSE_HIGH = 6.1
HIGH_FREQ_HIGH = 40.0
SPEECH_FREQ_HIGH = 25.0
MAX_HIGHLIGHTS = 6
HL_BP = "血压偏高："
HL_GLUCOSE = "血糖升高："
HL_CHEST = "胸片提示："
HL_LUNG = "肺功能异常提示："
HL_HIGH_FREQ = "高频听阈异常："
HL_SPEECH_FREQ = "语频听阈异常："
HL_ECG = "心电图提示："
HL_SYMPTOM = "自觉症状："

# ---------------------------------------------------------------------------
# FIXED VALUES: summary layout (section title, role list) and role labels
# ---------------------------------------------------------------------------
SUMMARY_LAYOUT = [
    ("基本信息", ["gender", "age", "job"]),
    ("职业暴露", ["total_years", "exposure_years", "hazard", "protection"]),
    ("关键检查", ["sbp", "dbp", "glucose", "chest_judgment", "lung", "high_freq", "speech_freq", "ecg"]),
]
ROLE_LABELS = {
    "gender": "性别", "age": "年龄", "job": "工种", "total_years": "总工龄",
    "exposure_years": "接害工龄", "hazard": "接触危害因素", "protection": "防护措施",
    "sbp": "收缩压", "dbp": "舒张压", "glucose": "血糖", "chest_judgment": "胸片判断",
    "lung": "肺功能", "high_freq": "高频听阈", "speech_freq": "语频听阈", "ecg": "心电图",
}
MAX_TAGS = 8
HIGHLIGHT_SECTION = "重点异常"
TAG_SECTION = "暴露标签"

# ---------------------------------------------------------------------------
# FIXED VALUES: query text
# ---------------------------------------------------------------------------
QUERY_CONCLUSION = "主检结论 "
QUERY_DIAGNOSIS = "诊断提示 "
QUERY_ROLES = ["job", "hazard", "chest_judgment", "lung", "ecg"]
QUERY_SEPARATOR = "；"
MAX_QUERY_PARTS = 12

# ---------------------------------------------------------------------------
# FIXED VALUES: template advice
# ---------------------------------------------------------------------------
EMPLOYMENT_ADVICE = {
    "职业禁忌证": "建议暂缓继续从事相关职业病危害因素暴露岗位，并由主检医师结合专科检查结果进一步复核。",
    "疑似职业病": "建议尽快进入职业病进一步诊断或复核流程，必要时临时调整离开相关危害暴露岗位。",
    "复查": "建议在完成复查项目之前维持观察管理，复核后再确认主检结论。",
}
EMPLOYMENT_DEFAULT = "当前未见必须立即调岗的直接证据，可结合岗位危害因素继续随访管理。"
FOLLOW_UP_DEFAULT = "结合本次异常项安排常规复查与动态随访。"
PREVENTION = [
    "持续落实岗位防尘、防噪声及个体防护用品佩戴。",
    "结合接触危害因素记录完善职业健康监护档案。",
    "对异常指标开展动态随访，避免仅凭单次结果做最终判断。",
]
NO_REFERENCES = "未检索到足够相关片段，已回退到通用建议模板。"
TEMPLATE_NOTICE = "尚未检测到可直接推理的本地基础模型，当前使用模板保底生成建议。"
ADVICE_HEADINGS = ["1. 岗位处置建议：", "2. 推荐复查与随访：", "3. 职业防护建议：", "4. RAG 依据片段：", "5. 模型状态："]
ADVICE_MODE = "template_fallback"
MAX_REFERENCES = 3
REFERENCE_CHARS = 120

# ---------------------------------------------------------------------------
# FIXED VALUES: report text
# ---------------------------------------------------------------------------
REPORT_TITLE = "职业健康主检智能推理报告"
REPORT_SECTIONS = ["一、样本有效信息", "二、主检结论", "三、判定依据", "四、RAG 片段", "五、主检建议"]

# ---------------------------------------------------------------------------
# FIXED VALUES: sources, trace, heuristic
# ---------------------------------------------------------------------------
SOURCE_RULES = "expert_system"
SOURCE_HEURISTIC = "heuristic_fallback"
SOURCE_MODEL = "model"
TRACE_VALUE_SEP = " | 当前值: "
HEURISTIC_TRACE = "LightGBM 执行异常时启用保底启发式规则。"

# ---------------------------------------------------------------------------
# FIXED VALUES: retrieval
# ---------------------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
TFIDF_NGRAM = (2, 4)
TFIDF_MAX_FEATURES = 12000
DEFAULT_TOP_K = 7
DENSE_WEIGHT = 0.58
SPARSE_WEIGHT = 0.42
OVERLAP_CAP = 8
OVERLAP_WEIGHT = 0.01
TITLE_WEIGHT = 0.012
HAZARD_BOOST = 0.16
HAZARD_GENERIC = "通用"
STANDARD_SOURCE_TYPES = ["national_standard_text", "national_standard_scan"]
STANDARD_BOOST = 0.05
REFERENCE_TYPE = "reference_range_rule"
REFERENCE_MATCH_BOOST = 0.22
REFERENCE_MISS_PENALTY = -0.12
REFERENCE_QUERY_TOKENS = ["参考范围", "阈值", "正常值", "异常值"]
REFERENCE_CAP = 2
METRIC_BOOST = 0.18
CONTRA_QUERY = "职业禁忌证"
CONTRA_DOC_TOKENS = ["职业禁忌证", "禁忌证"]
CONTRA_BOOST = 0.14
SUSPECT_QUERY = "疑似职业病"
SUSPECT_DOC_TOKENS = ["疑似职业病", "界定", "诊断"]
SUSPECT_BOOST = 0.14
RECHECK_QUERY = "复查"
RECHECK_DOC_TOKENS = ["复查", "随访", "进一步检查"]
RECHECK_BOOST = 0.08
MAX_VARIANTS = 6
NORM_RANGE_EPS = 1e-9

# ---------------------------------------------------------------------------
# FIXED VALUES: safe category encoding fallbacks (in order)
# ---------------------------------------------------------------------------
ENCODE_FALLBACKS = ["无", "未见异常", "正常", "合格", "未检", "未检查", "其他", ""]

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt assembly and generated-text gate
# ---------------------------------------------------------------------------
PROMPT_MAX_RECORD_LINES = 24
PROMPT_MAX_TRACE = 8
PROMPT_MAX_FEATURES = 6
PROMPT_MAX_DOCS = 5
PROMPT_DOC_CHARS = 220
PROMPT_NO_RECORD = "- 无"
PROMPT_NO_TRACE = "- 未提供规则路径"
PROMPT_NO_FEATURES = "- 未提供 SHAP/贡献度证据"
PROMPT_NO_DOCS = "- 未检索到片段"
PROMPT_UNTITLED = "未命名片段"
PROMPT_NO_DIAGNOSIS = "无"
GATE_MIN_CHARS = 40
GATE_BAD_MARKERS = ["无法作答", "信息不明确", "告诉我您想聊些什么", "和外星人交流", "请提供更多信息"]
GATE_HEADINGS = ["一、岗位处置建议", "二、复查/转诊建议", "三、职业防护与随访建议", "四、提示说明"]
GATE_MIN_HEADINGS = 2

# ---------------------------------------------------------------------------
# FIXED VALUES: stored tables
# ---------------------------------------------------------------------------
ANONYMOUS_USER = "anonymous"
RULE_HIT = "命中"
RULE_MISS = "未命中"
LIST_LIMIT = 100

# ---------------------------------------------------------------------------
# FIXED VALUES: metrics / scorecard
# ---------------------------------------------------------------------------
BOOTSTRAP_REPLICATES = 500
CI_ALPHA = 0.05
SEED = 42
TEST_SHARE = 0.3
RADAR_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "auc_ovo_macro", "mcc"]
TOP_ATTRIBUTIONS = 8
EXPLAIN_SAMPLE = 2000
SHARE_BUCKET_HIGH = 0.99995
SHARE_BUCKET_LOW = 0.00005
BAR_MIN = 2.0
BAR_MAX = 98.0

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt text (system prompt, user prompt template with
# {label} {diagnosis} {source} {evidence} {record} {query} {rag} slots)
# ---------------------------------------------------------------------------
PROMPT_SYSTEM = (
    "你是职业健康体检主检医生助理。"
    "请基于主检结论、证据依据和检索到的法规/知识片段，输出审慎、可执行的主检建议。"
    "不要编造未提供的检查结果，不要和主检结论冲突。"
    "如果证据不足，请明确说明“建议结合临床和职业史进一步确认”。"
)
PROMPT_USER_TEMPLATE = """请根据以下信息生成“主检建议”。

输出要求：
1. 用中文输出。
2. 只输出建议正文，不要解释你的推理过程。
3. 必须严格保留以下 4 个标题，并逐项填写具体内容：
   一、岗位处置建议：
   二、复查/转诊建议：
   三、职业防护与随访建议：
   四、提示说明：
4. 每部分 1-2 句，避免空话，不能 4 段都重复同一句话。
5. 若证据不足，可在“提示说明”中写“建议结合临床和职业史进一步确认”，但不要四段都只写这一句。

主检结论：{label}
诊断提示：{diagnosis}
判定来源：{source}

判定依据：
{evidence}

样本有效信息：
{record}

RAG 检索查询：
{query}

RAG 召回片段：
{rag}"""

"""Word lists and patterns whose values decide results.

FIXED VALUES: everything in this file is a constant table that must keep its
content and order; the operators that use the tables live elsewhere. Pass your
own tables to those operators to use another vocabulary.
"""

from __future__ import annotations

# ---- query routing ------------------------------------------------------
ABBREVIATIONS = [
    "dm", "t2dm", "t1dm", "htn", "copd", "ckd", "chf", "mi", "cad",
    "acs", "dvt", "pe", "ards", "aki", "uti", "tb", "hiv", "aids",
    "nsaid", "ace", "arb", "ccb", "bb", "ppi", "ssri", "snri",
    "ct", "mri", "ecg", "ekg", "eeg", "emg", "pet", "spect",
    "bp", "hr", "rr", "bmi", "hba1c", "ldl", "hdl", "tg", "alt", "ast",
    "bun", "cr", "gfr", "wbc", "rbc", "hgb", "plt", "inr", "pt", "ptt",
]
RECENCY_WORDS = [
    "最新", "2024", "2025", "2026", "新冠", "covid", "疫情",
    "最近", "近期", "刚刚", "新发现", "新研究", "新指南",
]
GENERAL_QUESTION_PATTERNS = [
    r"^什么是.{2,10}[？?]?$",
    r"^.{2,10}是什么[？?]?$",
    r"^.{2,6}的定义",
    r"^.{2,6}的概念",
]
EXACT_TOPIC_PATTERNS = [
    r"剂量|用量|用法",
    r"禁忌|禁忌症",
    r"适应症",
    r"不良反应|副作用",
    r"半衰期|药代动力学",
    r"参考值|正常值|正常范围",
    r"诊断标准|诊断依据",
    r"分期|分级|分类",
]
UNITS = "mg|ml|g|kg|mmol|umol|%"
SEMANTIC_WORDS = ["为什么", "如何", "怎么", "机制", "原理", "关系", "影响", "作用"]
ROUTE_ALPHA = {"vector": 0.9, "bm25": 0.3, "hybrid": 0.7, "direct": 0.5, "web": 0.5}
ROUTE_REASON = {
    "web": "查询涉及最新信息，建议联网搜索",
    "direct": "通用知识问题，可直接回答",
    "bm25": "查询包含需要精确匹配的医学术语或指标",
    "vector": "概念性/语义性问题，适合向量检索",
    "hybrid": "复杂查询，使用混合检索获得最佳效果",
}

# ---- query rewriting ----------------------------------------------------
TERM_SYNONYMS = {
    "糖尿病": ["diabetes", "DM", "血糖升高"],
    "高血压": ["hypertension", "HTN", "血压升高", "血压高"],
    "冠心病": ["冠状动脉粥样硬化性心脏病", "CAD", "coronary artery disease", "CHD"],
    "心梗": ["心肌梗死", "MI", "myocardial infarction", "急性心肌梗死", "AMI"],
    "脑梗": ["脑梗死", "缺血性脑卒中", "cerebral infarction"],
    "中风": ["脑卒中", "stroke", "脑血管意外", "CVA"],
    "肺炎": ["pneumonia", "肺部感染"],
    "肝炎": ["hepatitis", "肝脏炎症"],
    "肾衰": ["肾衰竭", "renal failure", "肾功能衰竭", "CKD"],
    "头疼": ["头痛", "headache", "头部疼痛"],
    "胸闷": ["胸闷气短", "胸部不适", "chest tightness"],
    "心慌": ["心悸", "palpitation", "心跳加快"],
    "气喘": ["呼吸困难", "dyspnea", "气促", "喘息"],
    "阿司匹林": ["aspirin", "ASA", "乙酰水杨酸"],
    "二甲双胍": ["metformin", "格华止", "美迪康"],
    "降压药": ["antihypertensive", "降血压药物"],
    "他汀": ["statin", "他汀类药物", "降脂药"],
    "心电图": ["ECG", "EKG", "electrocardiogram"],
    "CT": ["计算机断层扫描", "computed tomography"],
    "核磁": ["MRI", "磁共振", "magnetic resonance imaging"],
    "B超": ["超声", "ultrasound", "彩超"],
    "验血": ["血液检查", "blood test", "血常规"],
}
AMBIGUOUS_TERMS = {
    "糖尿病": {"1型": "1型糖尿病 (T1DM)", "2型": "2型糖尿病 (T2DM)", "妊娠": "妊娠期糖尿病 (GDM)"},
    "高血压": {"原发": "原发性高血压", "继发": "继发性高血压", "妊娠": "妊娠期高血压"},
}
FOLLOW_UP_PATTERNS = [
    r"^那.{0,5}呢[？?]?$",
    r"^.{0,3}怎么.{0,3}[？?]?$",
    r"^还有.{0,5}[？?]?$",
    r"^其他.{0,5}[？?]?$",
    r"^第[一二三四五]个",
]
FOLLOW_UP_WORDS = ["呢", "吗", "怎么", "那"]
FOLLOW_UP_COMPLETIONS = {
    "怎么预防": "的预防方法",
    "怎么治疗": "的治疗方法",
    "怎么诊断": "的诊断方法",
    "什么症状": "的症状",
    "什么原因": "的病因",
}
REPEAT_QUESTION = "那呢"
NO_REWRITE = "无需改写"

# ---- result assessment --------------------------------------------------
SUGGEST_EMPTY = ["尝试更宽泛的查询", "检查向量库是否有数据"]
SUGGEST_PARTIAL = ["尝试添加同义词或相关术语", "明确查询的具体方面（如症状、治疗、预防）"]
SUGGEST_MORE = "增加检索数量(top_k)"
SUGGEST_INSUFFICIENT = [
    "尝试不同的检索策略（如从向量改为关键词）",
    "检查查询是否在知识库覆盖范围内",
    "尝试更通用的查询词",
]
REASON_EMPTY = "未检索到任何文档"

# ---- conversations ------------------------------------------------------
SPEAKER = {"user": "用户", "other": "助手"}
SUMMARY_TOPICS = ["糖尿病", "高血压", "治疗", "症状", "预防", "诊断"]

# ---- prompts ------------------------------------------------------------
SYSTEM_PROMPT = """你是一个专业的医疗知识助手。请基于提供的参考文献，准确回答用户的医疗问题。

要求：
1. 回答必须基于参考文献内容，不要编造信息
2. 如果文献信息不足以回答问题，请明确说明
3. 对于涉及诊断、治疗的问题，提醒用户咨询专业医生
4. 引用文献时标注来源
5. 使用专业但易懂的语言"""
USER_PROMPT = "参考文献：\n{context}\n\n用户问题：{query}\n\n请基于以上参考文献回答用户问题。"
NO_ANSWER = "未找到相关文献，无法回答该问题。"
NO_RESULTS = "未找到相关医疗文献。"
UNKNOWN_SOURCE = "未知来源"
PART_SEPARATOR = "\n\n---\n\n"
OMITTED_MIDDLE = "\n\n[...文档中间部分已省略...]\n\n"
CONTEXT_PROMPTS = {
    "english": """<document>
{document}
</document>

Here is the chunk we want to situate within the whole document:
<chunk>
{chunk}
</chunk>

Please give a short succinct context to situate this chunk within the overall document for the purposes of improving search retrieval of the chunk. Answer only with the succinct context and nothing else.""",
    "chinese": """<document>
{document}
</document>

以下是需要添加上下文的文本块：
<chunk>
{chunk}
</chunk>

请为这个文本块生成简短的上下文说明，用于提升搜索检索效果。说明应该包含：
1. 这个文本块来自什么文档/主题
2. 文本块讨论的核心内容
3. 与文档整体的关系

只输出上下文说明，不要其他内容。请用中文回答。""",
    "medical": """<document>
{document}
</document>

以下是来自医学文献的文本块：
<chunk>
{chunk}
</chunk>

请为这个医学文本块生成简短的上下文说明（50-100字），用于提升医学信息检索效果。说明应包含：
- 文献类型（研究论文/临床指南/综述等）
- 涉及的疾病/症状/药物/治疗方法
- 文本块在文献中的位置（摘要/方法/结果/讨论等）

只输出上下文说明，不要其他内容。""",
    "compact": """你是医学文献分析专家。为文本块生成简短的检索上下文（50-80字）。

文档：
{document}

文本块：
{chunk}

要求：
1. 指明文献类型（论文/指南/综述）
2. 列出关键医学实体（疾病、药物、治疗）
3. 说明文本块在文档中的位置或作用

直接输出上下文，无需解释。/no_think""",
}
COMPACT_SYSTEM_PROMPT = """你是一个医学文献分析助手。你的任务是为文本块生成简洁的上下文描述，帮助提升检索效果。
要求：
- 输出简洁，50-80字
- 只输出上下文描述本身
- 不要输出思考过程
- 使用中文"""

# ---- entity extraction: (pattern, normalized name) per category ---------
ENTITY_PATTERNS = {
    "disease": [
        ("高血压", "高血压"),
        ("冠心病|冠状动脉粥样硬化性心脏病", "冠心病"),
        ("心肌梗[死塞]|心梗", "心肌梗死"),
        ("心[房室]颤动|房颤", "心房颤动"),
        ("心力衰竭|心衰", "心力衰竭"),
        ("心绞痛", "心绞痛"),
        ("[12I]型糖尿病|糖尿病", "糖尿病"),
        ("甲[状腺]*亢[进]?", "甲状腺功能亢进"),
        ("甲[状腺]*减[退]?", "甲状腺功能减退"),
        ("甲状腺结节", "甲状腺结节"),
        ("肺炎", "肺炎"),
        ("支气管炎", "支气管炎"),
        ("哮喘", "支气管哮喘"),
        ("慢性阻塞性肺[病疾]|COPD|慢阻肺", "慢性阻塞性肺疾病"),
        ("肺结核", "肺结核"),
        ("胃炎", "胃炎"),
        ("胃溃疡", "胃溃疡"),
        ("肝炎", "肝炎"),
        ("肝硬化", "肝硬化"),
        ("胆囊炎", "胆囊炎"),
        ("胆结石|胆石症", "胆石症"),
        ("幽门螺[杆旋]菌感染|Hp感染", "幽门螺杆菌感染"),
        ("脑卒中|中风|脑梗[死塞]?", "脑卒中"),
        ("帕金森[病症]?", "帕金森病"),
        ("阿尔茨海默[病症]?|老年痴呆", "阿尔茨海默病"),
        ("癫痫", "癫痫"),
        ("偏头痛", "偏头痛"),
        ("骨质疏松[症]?", "骨质疏松症"),
        ("类风湿[性]?关节炎", "类风湿关节炎"),
        ("骨关节炎", "骨关节炎"),
        ("腰椎间盘突出", "腰椎间盘突出"),
        ("慢性肾[脏病功能不全衰竭]|CKD", "慢性肾脏病"),
        ("肾结石", "肾结石"),
        ("肺癌", "肺癌"),
        ("胃癌", "胃癌"),
        ("肝癌", "肝癌"),
        ("乳腺癌", "乳腺癌"),
        ("结直肠癌|大肠癌", "结直肠癌"),
        ("抑郁[症障碍]?", "抑郁症"),
        ("焦虑[症障碍]?", "焦虑症"),
        ("失眠[症]?", "失眠"),
        ("新冠|COVID-?19|新型冠状病毒", "新型冠状病毒感染"),
        ("流感|流行性感冒", "流行性感冒"),
    ],
    "symptom": [
        ("发热|发烧|体温升高", "发热"),
        ("乏力|疲劳|无力", "乏力"),
        ("体重[下降减轻增加]", "体重变化"),
        ("水肿|浮肿", "水肿"),
        ("盗汗", "盗汗"),
        ("头痛|头疼", "头痛"),
        ("胸痛|胸闷", "胸痛"),
        ("腹痛|肚子痛", "腹痛"),
        ("关节痛", "关节痛"),
        ("腰痛|腰酸", "腰痛"),
        ("咳嗽", "咳嗽"),
        ("咳痰", "咳痰"),
        ("呼吸困难|气短|气促", "呼吸困难"),
        ("喘息|气喘", "喘息"),
        ("恶心", "恶心"),
        ("呕吐", "呕吐"),
        ("腹泻|拉肚子", "腹泻"),
        ("便秘", "便秘"),
        ("食欲[不振下降减退]", "食欲减退"),
        ("心悸|心慌", "心悸"),
        ("眩晕|头晕", "眩晕"),
        ("尿频", "尿频"),
        ("尿急", "尿急"),
        ("尿痛", "尿痛"),
        ("血尿", "血尿"),
        ("失眠|睡眠障碍", "失眠"),
        ("记忆力[下降减退]", "记忆力下降"),
        ("麻木", "麻木"),
        ("皮疹", "皮疹"),
        ("瘙痒", "瘙痒"),
        ("黄疸", "黄疸"),
    ],
    "medication": [
        ("二甲双胍", "二甲双胍"),
        ("格列[美苯吡奈齐]脲?", "磺脲类降糖药"),
        ("胰岛素", "胰岛素"),
        ("阿卡波糖", "阿卡波糖"),
        ("氨氯地平", "氨氯地平"),
        ("硝苯地平", "硝苯地平"),
        ("缬沙坦", "缬沙坦"),
        ("氯沙坦", "氯沙坦"),
        ("依那普利", "依那普利"),
        ("卡托普利", "卡托普利"),
        ("美托洛尔", "美托洛尔"),
        ("比索洛尔", "比索洛尔"),
        ("阿托伐他汀", "阿托伐他汀"),
        ("瑞舒伐他汀", "瑞舒伐他汀"),
        ("辛伐他汀", "辛伐他汀"),
        ("阿司匹林", "阿司匹林"),
        ("氯吡格雷", "氯吡格雷"),
        ("阿莫西林", "阿莫西林"),
        ("头孢[类克曲唑]*", "头孢类抗生素"),
        ("青霉素", "青霉素"),
        ("阿奇霉素", "阿奇霉素"),
        ("左氧氟沙星", "左氧氟沙星"),
        ("甲硝唑", "甲硝唑"),
        ("克拉霉素", "克拉霉素"),
        ("奥美拉唑", "奥美拉唑"),
        ("雷贝拉唑", "雷贝拉唑"),
        ("法莫替丁", "法莫替丁"),
        ("布洛芬", "布洛芬"),
        ("对乙酰氨基酚|扑热息痛", "对乙酰氨基酚"),
        ("泼尼松|强的松", "泼尼松"),
        ("地塞米松", "地塞米松"),
        ("维生素[A-Z]|维[A-Z]", "维生素"),
        ("钙[剂片]", "钙剂"),
    ],
    "examination": [
        ("CT|CT检查|计算机断层", "CT检查"),
        ("MRI|核磁共振", "MRI检查"),
        ("X[光线]?|胸片", "X线检查"),
        ("B超|超声", "超声检查"),
        ("心电图|ECG|EKG", "心电图"),
        ("胃镜", "胃镜检查"),
        ("肠镜", "肠镜检查"),
        ("血常规", "血常规"),
        ("尿常规", "尿常规"),
        ("肝功[能检查]?", "肝功能"),
        ("肾功[能检查]?", "肾功能"),
        ("血糖", "血糖"),
        ("糖化血红蛋白|HbA1c", "糖化血红蛋白"),
        ("血脂", "血脂"),
        ("甲[状腺]?功[能]?", "甲状腺功能"),
        ("肿瘤标志物", "肿瘤标志物"),
        ("血压", "血压测量"),
    ],
    "treatment": [
        ("手术[治疗]?", "手术治疗"),
        ("化疗|化学治疗", "化学治疗"),
        ("放疗|放射治疗", "放射治疗"),
        ("免疫治疗", "免疫治疗"),
        ("靶向治疗", "靶向治疗"),
        ("透析", "透析治疗"),
        ("支架[植入置入]?", "支架植入"),
        ("搭桥", "搭桥手术"),
        ("康复[治疗训练]?", "康复治疗"),
        ("物理治疗", "物理治疗"),
        ("中医治疗", "中医治疗"),
        ("针灸", "针灸治疗"),
        ("按摩|推拿", "推拿治疗"),
    ],
    "contraindication": [
        ("禁[忌用]于", "禁忌"),
        ("不[宜能适]用于", "不宜使用"),
        ("慎用", "慎用"),
        ("过敏", "过敏"),
        ("妊娠期禁用|孕妇禁用", "妊娠期禁用"),
        ("哺乳期禁用", "哺乳期禁用"),
        ("肝[功能]?损[害伤]", "肝功能损害"),
        ("肾[功能]?损[害伤]", "肾功能损害"),
    ],
}
ENTITY_CONFIDENCE = 0.9
DOSAGE_PATTERN = r"(\d+(?:\.\d+)?)\s*(mg|g|ml|片|粒|支|次/[日天]|[日天]/次)"

# ---- answer metrics -----------------------------------------------------
KEYWORD_RUNS = ["[一-鿿]+病", "[一-鿿]+症", "[一-鿿]+炎", "[一-鿿]+癌"]
KEYWORD_UNIT = r"\d+[\.\d]*\s*(mg|ml|g|%|毫克|毫升|克)"
KEYWORD_TERMS = ["治疗", "诊断", "症状", "预防", "药物", "手术", "检查", "禁忌", "副作用", "剂量", "疗程"]
OPPOSED_PAIRS = [("不能", "能够?"), ("禁止", "建议"), ("避免", "推荐")]
METRIC_WEIGHTS = {"semantic_f1": 0.4, "citation_accuracy": 0.3, "factual_consistency": 0.3}

# ---- evaluation sets ----------------------------------------------------
MIRAGE_DATASETS = ["mmlu", "medqa", "medmcqa", "pubmedqa", "bioasq"]
ANSWER_IS = " 答案是: "

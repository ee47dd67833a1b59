"""Word lists and tables that results depend on."""

# Stop words of keyword search.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "这", "那",
    "它", "他", "她", "们", "与", "或", "但", "而", "如果", "因为", "所以", "但是", "然后", "可以", "什么", "怎么", "为什么", "哪里", "哪个", "the", "a", "an", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "to", "of", "in", "on", "at", "for", "with", "by", "from", "as", "into", "through", "during", "and", "or", "but", "if", "then", "else", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "this", "that", "these", "those",
)

# Messages without information, in lower case.
CHITCHAT = (
    "你好", "您好", "早上好", "下午好", "晚上好", "嗨", "哈喽", "hi", "hello", "谢谢", "感谢", "thanks", "多谢", "好的", "好的,", "好的。", "ok", "okay", "嗯", "嗯嗯", "嗯哼", "再见",
    "拜拜", "bye", "收到", "明白", "了解", "清楚了", "知道了", "是的", "对的", "没错", "thank you",
)

# Words that make a Chinese text a question.
QUESTION_MARKS = (
    "请问", "是否", "能否", "可以吗", "您希望", "您是否", "请确认", "请您", "需要我", "要不要", "想不想", "确认一下",
)

# Pairs of opposites, positive and negative.
OPPOSITES = (
    ("喜欢", "不喜欢"), ("爱", "恨"), ("支持", "反对"), ("赞同", "反对"), ("赞成", "反对"), ("偏好", "排斥"), ("热爱", "憎恨"), ("开心", "难过"), ("高兴", "悲伤"), ("满意", "失望"),
    ("兴奋", "沮丧"), ("感动", "冷漠"), ("愉快", "痛苦"), ("喜欢", "讨厌"), ("期待", "绝望"), ("好", "坏"), ("优秀", "糟糕"), ("美丽", "丑陋"), ("聪明", "愚蠢"), ("勤奋", "懒惰"),
    ("勇敢", "懦弱"), ("善良", "邪恶"), ("诚实", "虚伪"), ("是", "不是"), ("对", "错"), ("正确", "错误"), ("真", "假"), ("有效", "无效"), ("合法", "非法"), ("开", "关"),
    ("启用", "禁用"), ("启动", "停止"), ("开始", "结束"), ("运行", "停止"), ("连接", "断开"), ("活", "死"), ("醒", "睡"), ("通", "断"), ("满", "空"), ("动", "静"), ("来", "去"),
    ("进", "出"), ("上", "下"), ("前", "后"), ("推", "拉"), ("抓", "放"), ("拿", "给"), ("买", "卖"), ("借", "还"), ("收", "发"), ("升", "降"), ("增加", "减少"),
    ("上升", "下降"), ("变大", "变小"), ("增强", "减弱"), ("加速", "减速"), ("多", "少"), ("大", "小"), ("高", "低"), ("长", "短"), ("深", "浅"), ("厚", "薄"), ("重", "轻"),
    ("快", "慢"), ("远", "近"), ("宽", "窄"), ("强", "弱"), ("粗", "细"), ("硬", "软"), ("松", "紧"), ("饱满", "干瘪"), ("有", "没有"), ("存在", "不存在"), ("包含", "不包含"),
    ("热", "冷"), ("暖", "凉"), ("亮", "暗"), ("明", "暗"), ("干", "湿"), ("新", "旧"), ("胜", "败"), ("早", "晚"), ("老", "少"), ("春", "秋"), ("积极", "消极"),
    ("主动", "被动"), ("乐观", "悲观"), ("自信", "自卑"), ("谦虚", "傲慢"), ("同", "异"), ("统一", "对立"), ("相同", "不同"), ("成功", "失败"), ("允许", "禁止"), ("接受", "拒绝"),
    ("同意", "拒绝"), ("肯定", "否定"), ("love", "hate"), ("good", "bad"), ("big", "small"), ("fast", "slow"), ("strong", "weak"), ("brave", "cowardly"),
    ("smart", "stupid"), ("beautiful", "ugly"), ("happy", "sad"), ("hot", "cold"), ("light", "dark"), ("hard", "soft"), ("loose", "tight"),
    ("old", "new"), ("empty", "full"), ("busy", "idle"), ("dry", "wet"), ("long", "short"), ("high", "low"), ("up", "down"), ("left", "right"),
    ("forward", "backward"), ("win", "lose"), ("pass", "fail"), ("alive", "dead"), ("awake", "asleep"), ("allow", "forbid"), ("accept", "reject"),
    ("agree", "refuse"), ("yes", "no"), ("true", "false"), ("success", "failure"),
)

# Marks of tools that hand work to another agent, and tags of turns worth keeping.
SUBAGENT_MARKS = (
    "subagent", "sub_agent", "delegate", "dispatch", "spawn",
)
HIGH_VALUE_TAGS = (
    "ToolCall", "Thinking", "AgentTool", "CodeBlock", "FileAttachment", "Image", "Video",
)

# By scenario, the batch threshold in tokens and the weights of recency, access, topic and mark.
SCENARIOS = {
    "coding": (500_000, 0.15, 0.15, 0.50, 0.20),
    "writing": (400_000, 0.15, 0.15, 0.40, 0.30),
    "research": (500_000, 0.10, 0.20, 0.50, 0.20),
    "daily": (200_000, 0.50, 0.20, 0.15, 0.15),
    "finance": (400_000, 0.20, 0.15, 0.35, 0.30),
    "design": (400_000, 0.15, 0.15, 0.35, 0.35),
    "office_work": (400_000, 0.35, 0.25, 0.20, 0.20),
    "agent_collaboration": (400_000, 0.15, 0.40, 0.30, 0.15),
    "knowledge_base": (500_000, 0.10, 0.35, 0.25, 0.30),
    "long_project": (500_000, 0.35, 0.15, 0.20, 0.30),
}
DEFAULT_THRESHOLD = 400_000

# By scenario, tags in order of priority.
PRIORITY_TAGS = {
    "coding": ("CodeBlock", "ToolCall", "Thinking", "Plan", "Url", "FileAttachment"),
    "writing": ("Text", "Citation", "Url", "Plan", "FileAttachment"),
    "research": ("Citation", "Url", "Text", "Plan", "Thinking", "FileAttachment"),
    "daily": ("Text", "Image", "Voice", "Url", "Video"),
    "finance": ("CodeBlock", "Text", "Url", "Status", "Citation"),
    "design": ("Image", "Text", "FileAttachment", "Ui", "Video"),
    "office_work": ("FileAttachment", "Text", "Plan", "Status", "Url", "Citation"),
    "agent_collaboration": ("ToolCall", "Thinking", "CodeBlock", "Text", "Plan"),
    "knowledge_base": ("Citation", "Text", "Url", "CodeBlock", "FileAttachment"),
    "long_project": ("Plan", "Status", "FileAttachment", "Text", "CodeBlock"),
}

# By scenario, words whose presence in a session speaks for it, in lower case.
SCENARIO_WORDS = {
    "coding": ("fn ", "class ", "def ", "function", "bug", "compile", "commit", "refactor", "api", "函数", "编译", "重构", "报错", "调试", "架构"),
    "writing": ("文章", "论点", "论据", "素材", "风格", "段落", "开头", "结尾", "修辞", "article", "essay", "draft", "outline", "narrative", "tone"),
    "research": ("假设", "方法", "数据", "结论", "引用", "文献", "实验", "样本", "论文", "hypothesis", "methodology", "conclusion", "citation", "abstract"),
    "daily": ("今天", "昨天", "吃饭", "天气", "心情", "朋友", "周末", "电影", "购物", "约会", "family", "dinner", "weather", "mood", "weekend"),
    "finance": ("交易", "金额", "收益", "风险", "投资", "股票", "基金", "利率", "止损", "portfolio", "stock", "bond", "dividend", "volatility", "hedge"),
    "design": ("设计", "原型", "用户", "界面", "交互", "迭代", "视觉", "反馈", "mockup", "wireframe", "ui", "ux", "persona", "iteration"),
    "office_work": ("会议", "待办", "文档", "决议", "项目", "截止", "参会", "纪要", "meeting", "todo", "memo", "deadline", "agenda", "minutes"),
}

# Factors by which an encoding's count is scaled to stand for another tokenizer.
TOKENIZER_FACTORS = {"o200k_base": 1.0, "cl100k_base": 1.0, "claude_approx": 1.20, "deepseek_approx": 0.95}

# Code points counted as CJK by the token estimate, and by the similarity functions.
CJK_WIDE = r"\u4E00-\u9FFF\u3400-\u4DBF\u3040-\u309F\u30A0-\u30FF\uAC00-\uD7AF"
CJK_NARROW = r"\u4E00-\u9FFF\u3400-\u4DBF"
CJK_SEARCH = r"\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF"

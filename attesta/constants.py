"""Patterns, word lists and thresholds that decide results.

Everything in this file is data.  The values have to be exactly these for results to agree with the
rules of the domain, so they are stated plainly and kept together.
"""

# --- whitespace: every character that counts as white space in Unicode text ---
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_NOT_SPACE = r"[\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")

# --- markdown link and image syntax ---
MD_IMAGE = r"!\[([^\]]*)\]\([^)]+\)"
MD_LINK = r"\[([^\]]+)\]\([^)]+\)"
MD_LINK_ANY_LABEL = r"\[([^\]]*)\]\([^)]+\)"

# --- price tokens ---
PRICE_SIGNS = "$€£¥₹"
PRICE_TOKEN = (
    r"(?iU)(?<![.\d])(?:\bUS\$|\bS\$|[$€£¥₹]|\b(?:USD|EUR|GBP|INR|CNY|CAD|AUD)\b|\bRs\.?)\s?"
    r"(?:\d[\d,]*(?:\.\d+)?|\.\d+)"
    r"|\d[\d,]*(?:\.\d+)?\s?(?:[$€£¥₹]|\b(?:USD|EUR|GBP|INR|CNY|CAD|AUD)\b|元)"
)
# spelling found in a lower-case token -> currency sign, tried in this order
CURRENCY_OF = [
    ("us$", "$"), ("usd", "$"), ("eur", "€"), ("gbp", "£"), ("inr", "₹"), ("cny", "¥"),
    ("cad", "$"), ("aud", "$"), ("s$", "$"), ("rs", "₹"), ("元", "¥"),
]
PRICE_STATEMENT = r"(?:US\$|S\$|Rs\.?|[$€£₹¥])\s?(?:\d[\d,\.]*|\.\d+)|免费|定价|价格|计费"

# --- billing periods ---
PERIOD_UNIT = r"(?iU)\s*(?:/\s*|per\s+)(?:users?|seats?|人|席位|坐席)(?![a-z])"
PERIOD_MONTH = r"(?i)month|/mo|月付|按月|每月|包月|月度"
PERIOD_YEAR = r"(?iU)year|\byr\b|annual|/yr|年付|按年|每年|包年|年度"
PERIOD_BILLED = r"(?i)billed|结算|discount|折扣|打折|优惠"
VALID_PERIODS = ["/mo", "billed", "/yr", "—", ""]
AUDIT_MONTHLY = r"(?i)^/?mo(nthly)?$|月付"
AUDIT_ANNUAL = r"(?i)billed|/yr|year|annual|年付|年"

# --- plan classes ---
FREE_NAME = r"(?i)^(free|starter free|free plan|免费)"
FREE_PRICES = ["free", "$0", "¥0", "€0", "£0", "0", "免费"]
CUSTOM_WORDS = r"(?i)custom|contact|quote|面议|定制|联系|咨询|get in touch"
PLAN_FREE_PRICES = ["free", "$0", "免费", "0"]

# --- URL type, first match wins ---
URL_TYPE_RULES = [
    ("docs", r"^https?://docs?\."),
    ("docs", r"/docs?(/|$)"),
    ("docs", r"/reference/"),
    ("docs", r"/api[-_]?(docs|reference)"),
    ("dashboard", r"^https?://app\."),
    ("dashboard", r"^https?://(console|panel|admin)\."),
    ("pricing", r"/pricing[-_]?(plan|plans|tier|tiers)?$"),
    ("pricing", r"/plan[-_]?s?$"),
    ("pricing", r"/price"),
    ("about", r"/(about|company|our[-_]?story|team|leadership|careers)"),
    ("integration", r"/integrations?(?:/|$)"),
    ("integration", r"/marketplace(?:/|$)"),
    ("customer", r"/(customer[-_]?stor(y|ies)|case[-_]?stud(y|ies))"),
    ("blog", r"/(blog|news|article|press|release)"),
    ("feature", r"/(feature|features|product|capabilities|whatsapp[-_]?business[-_]?api)"),
    ("changelog", r"/(changelog|release[-_]?notes?|updates?)"),
]
DEFAULT_URL_TYPE = "homepage"

# --- pages that publish prices: last path segment ---
PRICE_PAGE_SEGMENTS = ["pricing", "plans", "plan", "price", "prices", "定价", "价格", "套餐"]
AUDIT_PRICE_PAGE_SEGMENTS = ["pricing", "plans", "price", "prices", "定价", "价格", "套餐"]
SECTION_FRONT_SEGMENTS = [
    "docs", "documentation", "developers", "api", "reference", "en", "zh-cn", "v1", "v2",
]

# --- link discovery: page kinds in order, matched on link text or path ---
LINK_KINDS = [
    ("pricing", r"(?i)pricing|price|plans?|定价|价格|套餐"),
    ("features", r"(?i)features?|functionalit|capabilities|platform|product|产品|功能"),
    ("about", r"(?i)^about|about[-\s]us|company|our[-\s]story|team$|关于|公司"),
    ("docs", r"(?i)^docs?$|documentation|developers?|api[-\s]docs|//docs\."),
    ("testimonials", r"(?i)testimonials?|customer[-\s]?stor(y|ies)|case[-\s]?stud|success[-\s]?stor"
                     r"|customers$|reviews?|口碑|客户案例|用户评价"),
    ("blog", r"(?i)^blog$|blogs?/|news|changelog|release[-\s]?notes?|updates?|博客|动态"),
]
SHALLOW_KINDS = ["testimonials", "blog"]
LINK_IN_TEXT = r"(?<!!)\[([^\]\[]{2,40})\]\(([^)#\s]+)\)"
RESOURCE_SUFFIX = (
    r"(?i)\.(png|jpe?g|svg|webp|gif|avif|mp4|webm|css|js|mjs|ico|woff2?|ttf|otf|pdf|zip)$"
)

# --- capture engines: most trusted first ---
ENGINE_ORDER = ["firecrawl", "playwright", "trafilatura", "jina", "newspaper3k"]
ROUTES = {
    "pricing": ["playwright", "trafilatura", "jina"],
    "docs": ["trafilatura", "jina"],
    "dashboard": ["playwright"],
    "about": ["trafilatura", "jina"],
    "integration": ["trafilatura", "jina"],
    "customer": ["newspaper3k", "trafilatura"],
    "blog": ["newspaper3k", "trafilatura"],
    "feature": ["playwright", "trafilatura", "jina"],
    "changelog": ["trafilatura", "jina"],
    "testimonials": ["trafilatura", "newspaper3k"],
    "homepage": ["playwright", "trafilatura", "jina"],
}
LADDER = {
    "pricing": ["trafilatura", "jina", "newspaper3k"],
    "docs": ["jina", "playwright", "newspaper3k"],
    "homepage": ["jina", "newspaper3k"],
    "feature": ["jina", "newspaper3k"],
    "about": ["playwright", "newspaper3k"],
    "blog": ["jina", "playwright"],
    "customer": ["jina", "playwright"],
    "testimonials": ["jina", "playwright"],
    "changelog": ["playwright", "newspaper3k"],
    "integration": ["playwright", "newspaper3k"],
    "dashboard": [],
}

# --- text that is code, not prose ---
CODE_JUNK = (
    r"(function\s*\(|var\s+\w+\s*=|jQuery|document\.|window\.|=>\s*\{"
    r"|\.css-|!important|@media|<script|\\n\s*[{}]|\"@context\"|\{\"@"
    r"|--[\w-]+\s*:|gradient\(|animation\s*:|:root|@import|\.woff2?"
    r"|#[0-9a-fA-F]{3,8}\s*[;}]|self\.__next_f|partytown|pointer-events"
    r"|border-radius|radial-gradient|position\s*:\s*absolute)"
)
SCRIPT_LINE = (
    r"(?i)self\.\s*_?_*next_?\w*\s*\.?push|self\.__next_f"
    r"|\.push\(\s*\[\s*\d|webpackChunk|__NUXT__|\{\"@|\\n\\n|\\\\n"
    r"|^\s*\(self\.|\"sourceMappingURL\"|data:text/javascript"
)
STYLE_LINE = (
    r"(?i)\.css-[\w-]+\s*\{|@media\s*\(|@keyframes\s+[\w-]+\s*\{"
    r"|--[a-z][\w-]*\s*:\s*[\w#(]|font-family\s*:|!important"
    r"|url\(['\"]?data:|^[.#:][\w\s,.#:()>~-]+\{"
)
FRONT_MATTER = (
    r"(?i)^(---|title:|url:|hostname:|description:|sitename:|date:|tags:|published:)"
)
SCRIPT_SWITCH = r"[一-鿿][A-Za-z]|[A-Za-z][一-鿿]"
SENTENCE_END = r"[.。!?;:]$"

# --- claims ---
WRAPPED_QUOTE = r'官网原文:\s*"(.+?)"\s*"?$'
FABRICATED = (
    r"(?i)Pricing gets expensive at scale"
    r"|Best (?:value|tool) for (?:small|growing) (?:teams|businesses)"
    r"|Highly rated by (?:thousands of )?users worldwide"
)
REPR_LEAK = r"\['|\{\"|\"&#39;|\{'name':"
PLACEHOLDER = "待补充"
PLACEHOLDER_PREFIXES = ["待补充", "待 Step 3"]
MISSING_MARKS = ["", "—"]
TTL_DAYS = 14
STATS_WINDOW_DAYS = 90
BARE_VARIANT_WORDS = (
    r"(?i)/|month|year|annual|billed|pro|ai|premium|team|starter|growth|business|enterprise"
)

# --- audit ---
EXPECTED_KINDS = ["homepage", "pricing", "features", "docs", "testimonials"]
FIELD_MINIMUM = {
    "core_features": 12, "strengths": 3, "weaknesses": 1, "differentiators": 1,
    "tech_signals": 1, "feature_catalog": 4, "feature_conclusion_points": 1,
}
BLOCKING_FIELDS = ["feature_catalog", "feature_conclusion_points"]
REQUIRED_TEXTS = ["tagline", "pricing", "feature_best_for"]

# --- source labels by host fragment, first match wins ---
SOURCE_LABELS = [
    (["g2.com"], "G2 评测"),
    (["capterra"], "Capterra 评测"),
    (["reddit.com"], "Reddit 讨论"),
    (["trustpilot"], "Trustpilot"),
    (["crunchbase"], "Crunchbase"),
    (["36kr.com", "huxiu.com", "sspai.com"], "中文媒体报道"),
]
USER_SOURCES = ["g2.com", "reddit.com", "crunchbase.com"]
REVIEW_HOSTS = [
    "g2.com", "capterra", "producthunt", "reddit.com", "medium.com", "wikipedia.org",
    "youtube.com", "linkedin.com", "github.com", "trustpilot",
]

# --- feature names ---
NAME_MARKETING = (
    r"(?iU)\b(vs\.?|versus|explore|discover|power of|trusted by|proven results"
    r"|here's how|learn how|see how|introducing|get to know|meet the|why choose)\b"
)
NAME_BANNER = (
    r"(?iU)^manage\s+(options|services|vendors|preferences|consent)"
    r"|\{[^}]*\\[a-z][^}]*\}"
    r"|accept\s+(all|cookies)|cookie\s+preferences|do\s+not\s+sell|opt-out"
    r"|cookie\s+icon|^\s*(allow all|reject all|got it|dismiss)\s*$"
    r"|[؀-ۿ]|^[\"“‘]\["
)
NAME_NAV_WORDS = [
    "explorar", "descubrir", "descubre", "conocer más", "entdecken", "mehr erfahren",
    "découvrir", "en savoir plus", "scopri di più", "saiba mais", "了解更多",
]
ACCENTED = r"[àâäéèêëïîôöùûüçñáíóúÀÂÄÉÈÊËÏÎÔÖÙÛÜÇÑÁÍÓÚ]"
STEM_STOP = [
    "with", "para", "from", "your", "that", "this", "sem", "tanpa", "mais", "mas", "los", "las",
    "dos", "das", "and", "the", "for", "sin", "com", "de", "da", "do", "en", "es", "una", "uno",
]
STEM_SUFFIXES = ["ciones", "mente", "ando", "endo", "agem"]
WEAK_STEMS = [
    "integr", "integration", "platform", "manag", "management", "support", "tool", "toolbox",
    "servic", "connect", "connection", "channel", "custom", "customer", "client", "user",
    "featur", "provid", "provider", "solution", "enterpris", "enterprise", "cloud", "applic",
    "application", "dashboard", "report", "messag", "convers", "conversation", "workflow",
    "automat", "automation", "analyt", "analytic",
]

# --- free-text price lines ---
PRICE_LINE_SPLIT = r"\s/\s|[+、；;]"
PRICE_LINE_PRICE = r"(?i)(?:US\$|\$|€|£|S\$|₹|Rs\.?)\s?\d[\d,\.]*|免费|Free|联系销售|Contact Sales"
PRICE_LINE_PERIOD = r"(?i)billed\s+(annually|monthly)|per\s+(?:month|year)|/mo(?:nth)?|/yr|/年|/月"
PRICE_LINE_PLAN = (r"(?i)starter|growth|\bpro\b|plus|business|enterprise|team|basic|free\b"
                   r"|solo|scale|advanced|essential|standard|premium|lite")

# --- angles: keyword count decides, the first listed wins ties ---
ANGLES = [
    ("产品", ["产品", "UX", "界面", "体验", "设计", "编辑器", "协作", "功能"]),
    ("技术", ["技术", "架构", "AI", "模型", "引擎", "API", "性能", "算法"]),
    ("市场", ["市场", "增长", "用户", "客户", "份额", "营销", "GTM", "出海"]),
    ("商业", ["商业", "定价", "盈利", "营收", "订阅", "付费", "转化", "毛利"]),
    ("生态", ["生态", "集成", "合作伙伴", "API", "开放", "开发者", "插件"]),
    ("团队", ["团队", "组织", "工程", "文化", "招聘", "远程"]),
]
FACTUAL_POINT = r"(?i)客户|企业|规模|团队.*见引文"
FACTUAL_EXEMPT = r"(?i)认证|iso|bsp|partner|meta|量化|[0-9]+%|[0-9]+x|llms"
# pattern on the point -> advice, first match wins
ACTION_RULES = [
    (r"(?i)合规认证|iso|soc2|gdpr", "上线即做国际合规认证(ISO 27001/SOC2/GDPR)——中大客户采购的敲门砖,越早拿成本越低"),
    (r"(?i)官方合作|bsp|meta partner", "尽早拿下 Meta 官方 BSP/Partner 身份 —— 获得 API 配额与客户信任双红利"),
    (r"(?i)融资|series|raised", '用融资叙事建立市场信心(如 "{fact}"),配合产品里程碑做 PR 节奏'),
    (r"(?i)免费试用|self.*trial|免费注册", "产品驱动增长:自助免费试用入口 + 信用卡前置,降低获客摩擦"),
    (r"(?i)预约演示|demo|销售驱动", "双轨 GTM:自助试用(小客户)+ 预约演示(中大客户),按客单价分流"),
    (r"(?i)渠道|合作伙伴|partner.*体系|代理商", "建立渠道/代理商体系放大销售触角,尤其出海市场本地化分销"),
    (r"(?i)api.*优先|开发者|developer", "API-first + 开发者文档中心,让技术买家成为内部推动者"),
    (r"(?i)llms\.txt|openapi|机器可读|api.*文档|sdk", "把文档当产品做:机器可读(llms.txt/OpenAPI/全页 .md 输出)—— AI Agent 选型时代的新获客面"),
    (r"(?i)语音|voice|克隆", "语音+文字同线程服务(通话自动摘要回写 CRM)—— 高触达场景的体验差异点"),
    (r"(?i)量化|案例.*%|首响|[0-9]+x|客户案例", "客户案例全部带量化指标(首响时间/线索倍数/营收增长)—— 营销素材即选型证据"),
    (r"(?i)ai agent|三端|全链路|ai.*代理", "AI Agent 覆盖完整旅程(质检/推荐/排期/CRM 回写),而非单点问答机器人"),
    (r"(?i)双号|共存|coexistence", "支持 App/API 双号共存降低迁移摩擦 —— 团队保留既有习惯,平台获得 API 能力"),
    (r"(?i)cdp|客户数据平台|画像", "CDP 实时画像驱动个性化(收集-分析-营销-反馈闭环)"),
    (r"(?i)24/7|全天候|sla", "人+AI 混合 7×24 支持,SLA 化承诺写进套餐"),
]

# --- platform coverage keywords ---
PLATFORM_WORDS = {
    "web": ["dashboard", "console", "portal", "admin", "inbox"],
    "desktop": ["desktop", "electron", "native app", "windows app", "mac app"],
    "mobile": ["ios", "android", "mobile app", "native mobile"],
    "api": ["api", "sdk", "webhook", "rest", "graphql"],
}

# --- vendor names ---
NAME_SUFFIXES = [".io", ".com", ".ai", ".co", ".app", ".cloud"]

# --- English feature word -> label ---
FEATURE_LABELS = [
    ("team inbox", "团队收件箱"), ("shared inbox", "共享收件箱"), ("unified inbox", "统一收件箱"),
    ("broadcast", "批量群发"), ("campaign", "营销活动"), ("chatbot", "聊天机器人"),
    ("chat bot", "聊天机器人"), ("automation", "自动化"), ("flow builder", "流程编排器"),
    ("rule engine", "规则引擎"), ("a/b testing", "A/B 测试"), ("ab testing", "A/B 测试"),
    ("pr summary", "PR 摘要"), ("pull request", "拉取请求 (PR)"), ("inline comment", "行内评论"),
    ("code review", "代码审查"), ("code completion", "代码补全"), ("code generation", "代码生成"),
    ("code interpreter", "代码解释器"), ("vulnerability", "漏洞检测"), ("security scan", "安全扫描"),
    ("ide plugin", "IDE 插件"), ("ide integration", "IDE 集成"), ("self-host", "私有化部署"),
    ("self host", "私有化部署"), ("on-premise", "本地部署"), ("on-prem", "本地部署"),
    ("air-gapped", "隔离网络部署"), ("air gapped", "隔离网络部署"), ("customer journey", "客户旅程"),
    ("journey", "客户旅程"), ("transcript", "通话转写"), ("verification", "身份验证"),
    ("voice code", "语音验证码"), ("2fa", "双因素认证"), ("otp", "一次性验证码"),
    ("workflow", "工作流"), ("no-code", "无代码"), ("no code", "无代码"), ("webhook", "事件推送"),
    ("segmentation", "客户分群"), ("analytics", "数据分析"), ("dashboard", "仪表盘"),
    ("omnichannel", "全渠道"), ("multi-channel", "多渠道"), ("multichannel", "多渠道"),
    ("template message", "模板消息"), ("message template", "模板消息"), ("ai agent", "AI 智能体"),
    ("copilot", "AI 副驾驶"), ("co-pilot", "AI 副驾驶"), ("help desk", "工单支持"),
    ("lead", "销售线索"), ("pipeline", "销售管道"), ("chat widget", "网页聊天挂件"),
    ("live chat", "在线聊天"), ("permission", "权限管理"), ("rbac", "角色权限"),
    ("audit log", "审计日志"), ("data export", "数据导出"), ("single sign", "单点登录"),
    ("sso", "单点登录"), ("integration", "第三方集成"), ("shopify", "Shopify 电商集成"),
    ("salesforce", "Salesforce 集成"), ("hubspot", "HubSpot 集成"), ("payment", "支付收款"),
    ("stripe", "Stripe 支付"), ("survey", "问卷调研"), ("catalog", "商品目录"),
    ("catalogue", "商品目录"), ("abandoned cart", "弃购挽回"), ("order notification", "订单通知"),
    ("routing", "智能路由"), ("voice call", "语音通话"), ("video call", "视频通话"),
    ("file sharing", "文件分享"), ("quick reply", "快捷回复"), ("canned response", "预设回复"),
    ("label", "标签管理"), ("contact management", "联系人管理"), ("crm", "CRM 客户管理"),
    ("csat", "客户满意度"), ("nps", "净推荐值"), ("translation", "机器翻译"),
    ("scheduling", "定时发送"), ("qr code", "二维码"), ("mobile app", "移动端 App"),
    ("sdk", "SDK 开发包"), ("api", "API 接口"), ("onboarding", "上手引导"),
    ("migration", "数据迁移"), ("sla", "服务等级协议"), ("gdpr", "GDPR 合规"),
    ("compliance", "合规认证"), ("contact sync", "联系人同步"), ("user management", "用户管理"),
    ("report", "报表"), ("notification", "消息通知"), ("inbox", "收件箱"), ("email", "邮件发送"),
    ("sms", "短信发送"), ("bot", "机器人"), ("ai", "AI 能力"),
]

# --- default alias families: canonical name, exact aliases, phrase families ---
# A run passes its own alias table; these families are the default layer.
DEFAULT_ALIASES = [
    ("团队收件箱 (Team Inbox)",
     ["Team Inbox", "Shared Inbox", "Unified Inbox", "Agent Inbox", "Inbox", "团队收件箱"],
     ["team inbox", "shared inbox", "unified inbox", "agent inbox", "inbox", "收件箱"]),
    ("REST API 开放接口", ["REST API", "API", "Open API", "RESTful API"], []),
    ("Webhook 事件推送", ["Webhook", "Webhook Events", "Events API"], []),
    ("批量群发与营销活动 (Broadcast & Campaigns)",
     ["Broadcast", "Broadcasts", "Bulk Messaging", "营销活动", "群发"],
     ["broadcast", "bulk messaging", "campaign", "群发", "营销活动"]),
    ("AI 对话机器人 (AI Chatbot)",
     ["AI Chatbot", "AI Bot", "聊天机器人"],
     ["chatbot", "chat bot", "ai bot", "聊天机器人"]),
    ("自动化工作流 (Automation Workflow)",
     ["Automation Workflow", "Marketing Automation", "自动化工作流"],
     ["automation", "customer journey", "workflow", "自动化", "工作流"]),
    ("数据分析 (Analytics)",
     ["Analytics", "Conversation Analytics", "数据分析"],
     ["analytics", "insights", "数据分析"]),
    ("安全扫描 (Security Scanning)",
     ["Security Scanning", "Vulnerability Scan", "SAST", "安全扫描"],
     ["security scan", "vulnerab*", "sast", "安全扫描"]),
]

# --- default canonical capabilities: id, names, category, aliases ---
DEFAULT_CAPABILITIES = [
    ("team_inbox", "团队收件箱", "Team Inbox", "客服协作", ["team inbox", "shared inbox", "inbox"]),
    ("broadcast_campaign", "群发营销", "Broadcast Campaign", "营销自动化",
     ["broadcast", "campaign", "bulk message", "群发"]),
    ("ai_chatbot", "AI 聊天机器人", "AI Chatbot", "智能能力", ["chatbot", "chat bot", "ai agent"]),
    ("rest_api", "开放接口", "REST API", "集成开放", ["rest api", "open api"]),
    ("webhooks", "事件推送", "Webhooks", "集成开放", ["webhook", "event callback"]),
    ("analytics", "数据分析", "Analytics", "数据", ["analytics", "report"]),
    ("data_export", "数据导出", "Data Export", "数据", ["data export", "export"]),
    ("data_security", "数据安全", "Data Security", "合规", ["security scan", "audit log"]),
]

# --- known vendors: name -> home page, price page, documentation page ---
KNOWN_VENDORS = [
    ("WATI", "https://www.wati.io", "https://www.wati.io/pricing", "https://docs.wati.io"),
    ("Respond.io", "https://respond.io", "https://respond.io/pricing", None),
    ("ManyChat", "https://manychat.com", "https://manychat.com/pricing", None),
    ("Tidio", "https://www.tidio.com", "https://www.tidio.com/pricing/", None),
    ("Twilio", "https://www.twilio.com", "https://www.twilio.com/en-us/messaging/pricing",
     "https://www.twilio.com/docs"),
    ("Infobip", "https://www.infobip.com", "https://www.infobip.com/pricing",
     "https://www.infobip.com/docs"),
    ("Zendesk", "https://www.zendesk.com", "https://www.zendesk.com/pricing", None),
    ("Intercom", "https://www.intercom.com", "https://www.intercom.com/pricing", None),
]

SCORE_DIMENSIONS = [
    "feature_richness", "ux", "pricing_value", "integration", "ai_capability", "momentum",
]
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}

# marks in texts that are cut: between parts, before the windows kept, around the number of windows dropped
CUT_MIDDLE = "\n\n[... 中间内容已截断 ...]\n\n"
CUT_FOCUS = "\n\n[... 截断:以下为关键内容保窗 ...]\n\n"
CUT_DROPPED = ("[... 另有 ", " 个关键 token 窗口超出保留预算被丢弃 ...]\n\n")

# a text the evidence does not give yet
OPEN_TEXT = "open"
# how a vendor without published plans is shown
UNPUBLISHED = "未公开"

# what a lesson about prices says: evidence of a confirmed absence, and hints for the next run
NOT_PUBLISHED_EVIDENCE = ["官方定价页全引擎 0 价格 token", "替代路径已探测(help center/app市场/集团官网)"]
NOT_PUBLISHED_HINT = "下次运行直接采信「询价制」结论,跳过定价补爬,把预算让给功能/口碑深挖"
PARTIAL_PRICE_HINT = "定价深挖抓手:月/年 toggle、JS 套餐卡片、help center 定价页、第三方比价页"

# how a vendor sells, by the words of its plans
FREEMIUM, ENTERPRISE_ONLY, SUBSCRIPTION, MODEL_UNCLEAR = "免费增值(Freemium + 订阅)", "企业定制(Enterprise Only)", "SaaS 订阅(月付/年付)", "订阅制(细节见定价)"
# what a vendor's share of the common features says
COVERAGE_UNKNOWN, COVERAGE_BEST, COVERAGE_EVEN, COVERAGE_THIN = "功能信息不足", "覆盖最全", "覆盖均衡", "公开功能信息有限"
COVERAGE_OWN = " · 有独家能力"
# where a customer's voice comes from, after the name of its source
VOICE_QUOTE, VOICE_EFFECT, VOICE_OWN = " · 客户引语", " · 量化效果", " · 官网自述"
# company scale by stage
SMALL_STAGES, SMALL_SCALE = ["早期", "成长期"], "中小企业"
LARGE_STAGES, LARGE_SCALE = ["成熟期", "巨头"], "中大型企业"
# tiers of a rank
TIERS = ["领先", "中坚", "跟随"]

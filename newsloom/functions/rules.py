"""Fixed values of the rules: word lists, tables and limits.

All values in this file are fixed: results depend on them literally.
"""

# Platforms by kind, with the weight of the kind (others weigh 62).
PLATFORM_KINDS = {
    "official": (94.0, ["openai", "anthropic", "google-deepmind", "nvidia", "microsoft", "aws-ml", "meta-ai", "huggingface", "huggingface_papers_trending", "stanford_hai", "arxiv"]),
    "authority_media": (86.0, ["techcrunch-ai", "the-verge-ai", "mit-technology-review", "venturebeat", "ars-technica", "reuters", "wired"]),
    "chinese_media": (78.0, ["aibase", "36kr_ai", "wallstreetcn-news", "cls-depth", "solidot", "infoq", "jiqizhixin", "zhidx", "qbitai"]),
    "community": (64.0, ["aihot", "hacker-news", "product-hunt", "reddit", "github-trending"]),
}
OTHER_PLATFORM = 62.0
#: The most that a single platform of each kind scores.
SINGLE_CAPS = {"official": 90.0, "authority_media": 84.0, "chinese_media": 76.0, "community": 64.0}
PAPER_PLATFORMS = ["arxiv", "huggingface_papers_trending"]
COMMUNITY_HINTS = ["linux_do", "hacker", "product", "reddit", "github", "aihot"]

# Report event types.
IMPORTANCE = {"model_release": 92.0, "policy": 88.0, "hardware": 86.0, "infrastructure": 84.0, "product_release": 78.0, "partnership": 76.0, "legal": 74.0, "funding": 70.0, "acquisition": 72.0, "research": 68.0, "benchmark": 64.0, "open_source": 68.0, "tooling": 66.0, "company_business": 58.0, "company_policy": 56.0, "rumor": 45.0, "unknown": 45.0}
TYPE_ALIASES = {
    "product_launch": "product_release", "product launch": "product_release", "feature_launch": "product_release", "产品发布": "product_release", "产品更新": "product_release", "产品升级": "product_release", "新产品": "product_release", "AI产品发布": "product_release", "AI产品内测": "product_release",
    "模型发布": "model_release", "model_release": "model_release", "AI模型发布": "model_release", "AI模型更新": "model_release", "partnership": "partnership", "合作": "partnership", "政策合作": "partnership", "funding": "funding", "融资": "funding", "投资": "funding", "收购": "acquisition",
    "research": "research", "paper": "research", "arxiv": "research", "AI研究": "research", "技术突破": "research", "科研资助": "research", "benchmark": "benchmark", "政策发布": "policy", "政策限制": "policy", "公司政策": "company_policy", "公司业绩": "company_business", "公司重组": "company_business", "机构重组": "company_business",
    "AI硬件": "hardware", "AI芯片技术": "hardware", "芯片策略": "hardware", "AI基础设施": "infrastructure", "open_source_announcement": "open_source", "工具发布": "tooling", "product discovery": "rumor", "诉讼": "legal",
}
NEWS_TYPES = ["product_release", "model_release", "partnership", "funding", "acquisition", "policy", "company_policy", "company_business", "hardware", "infrastructure", "legal"]
INSIGHT_TYPES = ["research", "benchmark"]
ASSET_LAYER_TYPES = ["open_source", "tooling", "framework", "library", "course", "book", "paper"]
HIGH_IMPACT_TYPES = ["model_release", "policy", "hardware", "infrastructure", "partnership", "legal"]
ACTIONABLE_TYPES = ["model_release", "product_release", "open_source", "tooling", "framework", "library", "benchmark", "hardware", "infrastructure", "policy", "legal"]
PRACTICAL_TYPES = ["policy", "legal", "hardware", "infrastructure"]
NOVEL_TYPES = ["model_release", "product_release", "open_source", "research", "benchmark"]
POLICY_TYPES = ["policy", "legal", "company_policy"]
PAPER_TYPES = ["research", "benchmark", "paper"]
ASSET_TYPES = ["open_source", "tooling", "framework", "library", "paper", "benchmark", "research"]
WATCH_TYPES = ["rumor", "company_business", "company_policy", "funding", "partnership", "product_release", "model_release"]
TOP_TYPE_LIMITS = {"model_release": 3, "product_release": 2, "company_business": 2, "company_policy": 2, "policy": 2, "legal": 2, "funding": 2, "partnership": 2}
OTHER_TYPE_LIMIT, ENTITY_LIMIT, PLATFORM_LIMIT = 3, 2, 3
#: Types of the extraction step; others become "other".
EXTRACTION_TYPES = ["model", "product", "research", "infrastructure", "hardware", "funding", "partnership", "policy", "safety", "security", "open_source", "company", "acquisition", "litigation", "application", "benchmark", "other"]

# Words, tested as substrings in lower case.
AI_WORDS = ["ai", "llm", "agent", "agents", "chatgpt", "codex", "claude", "gemini", "gpt", "openai", "deepmind", "nvidia", "copilot", "model", "inference", "芯片", "模型", "智能体", "大模型", "人工智能", "推理", "算力"]
RUMOR_WORDS = ["rumor", "reportedly", "消息称", "据称", "预计", "或将", "疑似", "seems", "appears"]
INSIGHT_WORDS = ["paper", "research", "benchmark", "study", "method", "evaluation", "experiment", "论文", "研究", "评测", "方法"]
ASSET_LAYER_WORDS = ["github", "open source", "opensource", "repo", "repository", "framework", "library", "toolkit", "sdk", "course", "book", "readme", "benchmark suite", "dataset", "开源", "仓库", "框架", "工具", "课程", "书", "数据集"]
ACTIONABLE_WORDS = ["api", "sdk", "github", "repo", "release", "launch", "available", "preview", "benchmark", "dataset", "open source", "download", "deploy", "integration", "开源", "发布", "上线", "接入", "部署", "测试", "试用", "基准", "数据集"]
FOLLOW_UP_WORDS = ["again", "update", "follow-up", "recap", "roundup", "summary", "rumor", "再次", "更新", "后续", "汇总", "传闻"]
NOVELTY_WORDS = ["first", "new", "launch", "release", "introduce", "announce", "open source", "首次", "新", "发布", "推出", "开源", "上线"]
PAPER_SIGNAL_WORDS = ["paper", "arxiv", "research", "benchmark", "dataset", "method", "model", "architecture", "evaluation", "agent", "ocr", "memory", "retrieval", "rl", "reinforcement learning", "论文", "研究", "基准", "数据集", "方法", "模型", "架构", "评测", "智能体", "记忆", "检索", "强化学习"]
PAPER_CODE_WORDS = ["code", "github", "dataset", "benchmark", "framework", "toolkit", "open source", "代码", "开源", "数据集", "基准", "框架", "工具"]
PAPER_WORDS = ["paper", "arxiv", "benchmark", "dataset", "research", "method", "architecture", "论文", "基准", "数据集", "研究", "方法", "架构"]
REUSABLE_WORDS = ["github", "repo", "repository", "open source", "opensource", "framework", "toolkit", "sdk", "library", "dataset", "benchmark", "code", "agent", "memory", "retrieval", "ocr", "开源", "仓库", "框架", "工具", "数据集", "基准", "代码", "智能体", "记忆", "检索"]
ASSET_WORDS = ["github", "repo", "repository", "open source", "opensource", "framework", "toolkit", "sdk", "library", "benchmark", "dataset", "paper", "arxiv", "model card", "readme", "开源", "仓库", "框架", "工具", "数据集", "论文", "基准"]
ASSET_EXCLUDE = ["course", "academy", "education", "课程", "教育"]
COMPUTE_WORDS = ["chip", "gpu", "hbm", "blackwell", "rubin", "jetson", "inference", "compute", "datacenter", "data center", "accelerator", "semiconductor", "nvidia", "broadcom", "tsmc", "芯片", "算力", "推理", "半导体", "数据中心", "英伟达", "存储", "晶圆"]
BIOMED_WORDS = ["biology", "biomedical", "medicine", "drug", "pharma", "life science", "protein", "genomics", "clinical", "molecule", "chemistry", "bionemo", "gene", "生物", "生物医药", "医药", "生命科学", "药物", "制药", "蛋白", "基因", "临床", "分子", "化学"]
FOCUS_WORDS = {
    "ai_compute_chip": ["chip", "semiconductor", "gpu", "hbm", "memory", "wafer", "foundry", "tsmc", "samsung", "sk hynix", "nvidia", "cuda", "asic", "tpu", "data center", "datacenter", "inference", "compute", "blackwell", "rubin", "gb300", "jetson", "trainium", "accelerator", "芯片", "半导体", "算力", "推理", "显卡", "晶圆", "代工", "内存", "存储", "数据中心", "高带宽内存", "封装", "台积电", "三星", "海力士", "英伟达", "华为芯片"],
    "ai_biomedicine": ["biology", "biomedical", "medicine", "drug", "pharma", "chemist", "chemistry", "life science", "protein", "genomics", "clinical", "molecule", "molecular", "reaction", "synthesis", "therapeutic", "medicinal", "lifescibench", "molecule.one", "生命科学", "生物", "生物医药", "医药", "药物", "制药", "化学", "药物化学", "蛋白", "基因", "临床", "分子", "合成", "实验室", "反应", "疾病", "治疗", "药企"],
}
FOCUS_BOOSTS = {"ai_compute_chip": {"importance": 8.0, "relevance": 10.0, "actionability": 8.0, "novelty": 3.0}, "ai_biomedicine": {"importance": 8.0, "relevance": 12.0, "actionability": 7.0, "novelty": 5.0}}

# Weights of the final score, and sizes of the sections.
WEIGHTS = {"importance": 0.32, "source": 0.12, "freshness": 0.16, "relevance": 0.17, "actionability": 0.12, "novelty": 0.11}
SECTION_SIZES = {"top_news": 8, "insight": 4, "deep_asset": 4, "watchlist": 3}

# Text rules.
MOJIBAKE = ["�", "鐨", "鍙", "鏄", "涓", "绋", "鎺", "彂", "竴", "鈥", "锟"]
TITLE_PREFIXES = ["快讯", "报道", "消息称", "消息", "热搜", "全文", "视频"]
OFFICIAL_DOMAINS = ["openai.com", "anthropic.com", "deepmind.google", "googleblog.com", "nvidia.com", "microsoft.com", "meta.com", "huggingface.co", "github.com", "arxiv.org"]
ACCESS_MARKERS = ["cloudflare", "cf-chl", "cf-ray", "captcha", "hcaptcha", "recaptcha", "access denied", "request blocked", "rate limit", "too many requests", "verify you are human", "please enable cookies"]
PAGE_MARKERS = ["captcha", "cloudflare", "cf-challenge", "awswaf.com", "challenge.js", "rate limit", "too many requests", "access denied", "login required"]
BACKGROUND = [r"[^。！？.!?]*证据(?:强度|来自|来源)[^。！？.!?]*[。！？.!?]", r"[^。！？.!?]*(?:页面|内容)(?:未完全加载|不可读|抓取失败)[^。！？.!?]*[。！？.!?]", r"[^。！？.!?]*仍需(?:进一步)?核验[^。！？.!?]*[。！？.!?]", r"[^。！？.!?]*单一(?:来源|媒体报道)[^。！？.!?]*[。！？.!?]"]

# Texts of the report.
WHY = {
    "model_release": "这可能影响模型能力边界、开发者工具链和同类产品竞争。", "product_release": "这会影响 AI 产品形态、用户工作流以及竞品后续跟进方向。", "partnership": "这说明 AI 能力正在通过产业合作进入更大规模的落地阶段。", "funding": "这反映资本对该方向的持续关注，也可能改变赛道竞争格局。",
    "policy": "这可能影响 AI 产品合规、市场进入和企业部署策略。", "hardware": "这会影响推理成本、算力供给和 AI 基础设施竞争。", "infrastructure": "这关系到模型部署、推理效率和企业级 AI 应用的成本结构。", "research": "这类内容适合作为团队理解技术趋势和方法论的参考。",
    "benchmark": "这有助于判断模型或工具在真实任务中的能力边界。", "open_source": "这类资源适合进入长期资产池，后续可用于工程实践或方案参考。", "tooling": "这可能提升研发效率，适合作为团队工具链候选项观察。", "legal": "这可能影响 AI 内容使用、版权合规和平台责任边界。",
}
WHY_OTHER = "这条信息与 AI 行业动态相关，适合进入团队情报池继续观察。"
TYPE_NOUNS = {"model_release": "模型发布", "product_release": "产品更新", "policy": "政策与合规动态", "partnership": "合作动态", "hardware": "AI 硬件动态", "infrastructure": "AI 基础设施动态", "research": "研究进展", "benchmark": "评测与基准动态", "open_source": "开源项目", "tooling": "工具更新", "funding": "融资动态", "legal": "法律与版权动态"}
TITLE_REWRITES = [
    ("openai has new ai models", "OpenAI 新模型发布受限"), ("nvidia-aws ai production collaboration", "NVIDIA 与 AWS 合作推动 AI 生产级部署"), ("diffusiongemma", "DiffusionGemma 文本生成模型发布"), ("gemma 4 12b", "Gemma 4 12B 多模态模型发布"),
    ("pp-ocrv6", "PP-OCRv6 多语言 OCR 模型发布"), ("france advances", "法国借助 NVIDIA 技术推进欧洲 AI 布局"), ("policy on the ai exponential", "AI 公司发布 AI 指数增长政策"), ("ffasr", "FFASR 真实场景 ASR 评测榜单发布"),
    ("lifescibench", "OpenAI 发布生命科学 AI 基准 LifeSciBench"), ("cuga", "CUGA 智能体应用框架发布"), ("openai academy", "OpenAI Academy 推出面向未来工作的 AI 课程"), ("ornith-1.0", "Ornith-1.0 智能体编程模型发布"),
]
SUMMARY_REWRITES = [
    ("openai has new ai models", "OpenAI 因政府审批要求限制新模型发布范围。"), ("nvidia-aws ai production collaboration", "NVIDIA 与 AWS 合作，推动 AI 模型训练和企业生产部署。"), ("diffusiongemma", "Google DeepMind 发布 DiffusionGemma，主打更快的文本生成。"), ("gemma 4 12b", "Google DeepMind 发布 Gemma 4 12B，定位为统一的多模态模型。"),
    ("pp-ocrv6", "AI 社区上线 PP-OCRv6 多语言 OCR 模型，覆盖多种语言场景。"), ("france advances", "法国正借助 NVIDIA 技术推动欧洲 AI 基础设施和产业布局。"), ("policy on the ai exponential", "AI 公司发布关于 AI 指数增长的政策立场。"), ("ffasr", "FFASR 推出面向真实场景的 ASR 能力评测榜单。"),
    ("lifescibench", "OpenAI 发布 LifeSciBench，用于评估 AI 在生命科学任务中的能力。"), ("cuga", "AI 社区发布 CUGA，提供多个智能体应用示例和轻量工具框架。"), ("openai academy", "OpenAI Academy 推出新课程，聚焦 AI 在未来工作中的应用。"), ("ornith-1.0", "Ornith-1.0 是面向智能体编程的开源模型线索，仍需复核。"),
]
ACTIONS = [(r"(?i)\bintroduc(?:e|es|ed|ing)\b", "推出"), (r"(?i)\breleas(?:e|es|ed|ing)\b", "发布"), (r"(?i)\blaunch(?:es|ed|ing)?\b", "上线"), (r"(?i)\bpartner(?:s|ed|ing)?\b|\bcollaborat(?:e|es|ed|ing)\b", "合作推进"), (r"(?i)\blimit(?:s|ed|ing)?\b|\brestrict(?:s|ed|ing)?\b", "限制")]
DETAILS = [(["agent"], "智能体"), (["coding", "code", "codex"], "AI 编程"), (["multimodal"], "多模态能力"), (["benchmark", "leaderboard"], "能力评测"), (["inference", "chip", "hbm"], "推理与算力"), (["policy", "government", "copyright"], "政策合规"), (["open-source", "open source"], "开源生态")]
STATUS_LABELS = {"verified": "已核验", "single_source": "单源可信", "rumor": "待观察", "needs_review": "需人工复核"}
STRENGTH_LABELS = {"strong": "较强", "medium": "中等", "weak": "偏弱", "none": "暂无"}
TOPIC_LABELS = {"infrastructure": "基础设施", "hardware": "硬件与芯片", "benchmark": "评测基准", "research": "研究方法", "open_source": "开源资源", "product": "产品工具", "product_release": "产品发布", "model_release": "模型发布", "partnership": "产业合作", "policy": "政策治理", "funding": "资本与上市"}

# Weights of the section scores, of the risk penalty in them and of a strategic focus.
SECTION_WEIGHTS = {
    "top_news": {"importance": 0.40, "source": 0.14, "freshness": 0.22, "relevance": 0.14, "novelty": 0.10},
    "insight": {"novelty": 0.32, "relevance": 0.28, "source": 0.10, "importance": 0.18, "freshness": 0.12},
    "deep_asset": {"actionability": 0.38, "novelty": 0.26, "source": 0.10, "relevance": 0.16, "importance": 0.10},
    "watchlist": {"importance": 0.34, "novelty": 0.18, "actionability": 0.16, "freshness": 0.14, "relevance": 0.10},
}
SECTION_RISK = {"top_news": 0.45, "insight": 0.35, "deep_asset": 0.30}
SECTION_STRATEGIC = {"top_news": 1.0, "insight": 0.80, "deep_asset": 0.65, "watchlist": 0.90}

# Task states, log entries of an attempt history, words of scrape errors.
ACTIVE_STATES = ["queued", "waiting", "running"]
SUCCESS_STATES = ["succeeded", "skipped"]
TERMINAL_STATES = ["succeeded", "failed", "blocked", "cancelled", "skipped"]
HISTORY_TYPES = ["task.registered", "task.started", "task.waiting", "task.retry_scheduled", "task.retry_requested", "task.completed", "task.failed", "task.blocked", "task.cancelled", "task.skipped", "task.unblocked"]
ACCESS_WORDS = ["cloudflare", "captcha", "cf-chl", "cf-ray", "attention required", "enable javascript", "access denied", "rate limit", "too many requests", "login required", "forbidden"]
NETWORK_WORDS = ["timeout", "timed out", "connection reset", "connection aborted", "temporary failure", "name resolution", "ssl", "tls", "proxy"]

"""Word lists, weights and patterns that results depend on."""

# Categories and the hints that a text is searched for, in the order that breaks ties.
CATEGORY_HINTS = {
    "evaluation-benchmarks": ["benchmark", "evaluation", "eval", "dataset", "leaderboard", "protocol", "diagnostic"],
    "reasoning": ["reasoning", "chain-of-thought", "cot", "math", "verifiable", "test-time", "inference-time"],
    "rl-post-training": ["reinforcement learning", "rl", "preference", "reward", "policy optimization", "post-training", "alignment tuning"],
    "agents-tool-use": ["agent", "tool use", "computer use", "web agent", "multi-agent", "workflow", "planner"],
    "rag-knowledge": ["rag", "retrieval augmented", "retrieval-augmented", "knowledge", "memory", "context engineering"],
    "alignment-safety": ["safety", "alignment", "hallucination", "jailbreak", "toxicity", "robustness", "guardrail"],
    "efficiency-systems": ["efficient", "efficiency", "token", "latency", "serving", "runtime", "compression", "moe", "routing"],
    "coding-formal-tasks": ["code", "coding", "program", "formal", "theorem", "proof", "software engineering"],
    "mllm-foundations": ["multimodal large language model", "mllm", "multi-modal", "multimodal", "foundation model"],
    "vlm-understanding": ["vision-language", "vlm", "image-text", "visual question answering", "vqa", "caption", "retrieval"],
    "video-understanding": ["video", "temporal", "long video", "movie", "frame", "action recognition"],
    "audio-speech": ["audio", "speech", "voice", "asr", "tts", "sound"],
    "three-d-world-modeling": ["3d", "three-dimensional", "world model", "scene", "motion", "spatial", "geometry"],
    "vla-embodied-learning": ["vision-language-action", "vla", "embodied", "manipulation", "control task", "humanoid"],
    "robotics-planning": ["robot", "robotics", "planning", "control", "trajectory", "policy", "navigation"],
    "scientific-discovery": ["science", "scientific", "biology", "chemistry", "molecule", "protein", "materials"],
    "data-synthesis-curation": ["data synthesis", "synthetic data", "curation", "augmentation", "data cleaning", "dataset construction"],
    "multimodal-generation": ["generation", "diffusion", "image generation", "video generation", "editing", "text-to-image", "text-to-video"],
}
DEFAULT_CATEGORY = "mllm-foundations"

# Hints of the focus score, and the further terms of a relevant title.
FOCUS_HINTS = [
    "large language model", "language model", "llm", "vlm", "vla", "mllm", "multimodal", "multi-modal", "vision-language", "vision language", "agent", "reasoning",
    "retrieval", "hallucination", "video", "robot", "embodied", "world model", "computer use",
]
RELEVANT_TERMS = ["large language", "language model", "vision-language", "vision language", "multimodal", "multi-modal", "mllm", "vllm", "lv lm", "vla", "embodied", "world model"]

# Keys of a guide.
INTRO_KEYS = ["motivation", "problem", "analysis", "method", "experiment", "contribution"]

# Query expansion; label, aliases, categories, terms.
DICTIONARY = [
    ("长上下文推理", ["长上下文", "长 context", "long context", "长思维", "test-time scaling"], ["reasoning", "efficiency-systems"], ["context", "long-context", "scaling", "reasoning"]),
    ("推理", ["推理", "reasoning", "cot", "chain of thought", "数学"], ["reasoning", "rl-post-training", "coding-formal-tasks"], ["reasoning", "chain-of-thought", "math"]),
    ("强化学习", ["rl", "强化学习", "post training", "后训练", "policy optimization"], ["rl-post-training", "vla-embodied-learning"], ["reinforcement learning", "policy", "optimization"]),
    ("Agent", ["agent", "智能体", "tool use", "工具调用", "computer use", "多代理"], ["agents-tool-use", "efficiency-systems"], ["agent", "tool", "computer use", "multi-agent"]),
    ("RAG / Memory", ["rag", "检索增强", "知识库", "记忆", "context engineering"], ["rag-knowledge", "agents-tool-use"], ["retrieval", "knowledge", "memory", "context"]),
    ("幻觉与对齐", ["幻觉", "hallucination", "safety", "对齐", "mitigation"], ["alignment-safety", "vlm-understanding"], ["hallucination", "safety", "alignment", "mitigation"]),
    ("视频理解", ["视频", "video", "长视频", "temporal", "social reasoning"], ["video-understanding", "multimodal-generation"], ["video", "temporal", "social", "causal"]),
    ("图文检索", ["图文", "image-text", "retrieval", "matching", "对齐"], ["vlm-understanding", "mllm-foundations"], ["image-text", "matching", "retrieval", "semantic"]),
    ("3D / Motion", ["3d", "三维", "motion", "动作生成", "世界模型", "world model"], ["three-d-world-modeling", "multimodal-generation"], ["3d", "motion", "world model", "scene"]),
    ("具身", ["具身", "embodied", "vla", "robot", "policy"], ["vla-embodied-learning", "robotics-planning"], ["vision-language-action", "policy", "robot", "embodied"]),
]

# Words without meaning for acronyms.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "via", "with", "without"]

# Venue rules in order (word, venue), their year, and words of other tracks.
VENUES = [("aaai", "AAAI"), ("acl", "ACL 2026"), ("emnlp", "EMNLP 2026"), ("iccv", "ICCV 2026"), ("iclr", "ICLR 2026"), ("icml", "ICML 2026"), ("ijcai", "IJCAI 2026"), ("kdd", "KDD 2026"), ("colm", "COLM 2026"), ("cvpr", "CVPR 2026"), ("mm", "MM 2026"), ("neurips?", "NeurIPS 2026"), ("sigir", "SIGIR 2026"), ("www", "WWW 2026")]
VENUE_YEAR = 2026
OTHER_TRACKS = "findings|workshop|tutorial|demo|challenge|shared task|short paper|industry track|system demo|poster session|competition|dataset track"
EVIDENCE_VENUES = "aaai|acl|emnlp|cvpr|iccv|iclr|icml|neurips|siggraph|kdd|www|ijcai|colm|mm|sigir"
EVIDENCE_OTHER_TRACKS = "findings|workshop|demo|tutorial|challenge|shared task|blogpost|blog post|competition|supplementary"
EVIDENCE_CONTEXT = "accepted|official|repo|repository|code|implementation|project page|main conference|main track|paper|oral|poster|to appear"

# Terms and weights of evidence scores.
EVIDENCE_TERMS = {
    "paper": {"paper": 3, "preprint": 2, "arxiv": 3, "project page": 4, "technical report": 2, "论文": 3, "预印本": 2},
    "announcement": {"introducing": 3, "new work": 3, "our work": 2, "our paper": 4, "accepted to": 5, "accepted by": 4, "paper accepted": 5, "to appear": 3, "official code": 4, "official repo": 4, "official implementation": 3, "开源": 1, "新论文": 4, "论文录用": 5, "录用": 4},
    "topic": dict.fromkeys(["llm", "large language model", "vlm", "vision-language", "vision language", "mllm", "multimodal", "multi-modal", "vla", "agent", "reasoning", "robotics", "embodied", "video understanding", "3d gaussian", "3dgs", "gaussian splatting", "world model", "rag", "post-training", "reinforcement learning", "大模型", "多模态", "智能体", "具身"], 2),
    "venue": dict.fromkeys(["aaai", "acl", "emnlp", "cvpr", "iccv", "iclr", "icml", "neurips", "siggraph", "ijcai", "colm", "kdd", "www", "顶会"], 2),
}
REJECT_TERMS = ["miniapp", "小程序开放平台", "招聘", "课程", "tutorial", "challenge", "call for papers", "cfp", "workshop", "sponsor", "product", "documentation", "presentation generator", "awesome", "curated list", "reading list", "survey list", "leaderboard"]
STAGE_WEIGHTS = {"model-plan": 2, "follow-up": 2, "seed": 2, "repository": 2, "paper-index": 1, "homepage": 1}
STAGE_BONUS = {"model-plan": 1, "follow-up": 2}
HIGH_SIGNAL_URL = r"arxiv\.org|github\.com|github\.io|openreview\.net|x\.com|twitter\.com|\.edu"

# Topics in a text.
TOPICS = [
    "large language model", "llm", "vision language model", "vlm", "multimodal", "mllm", "vision language action", "vla", "agent", "reasoning", "video understanding",
    "3d gaussian splatting", "3dgs", "robotics", "embodied ai", "rag", "benchmark", "post-training", "reinforcement learning", "world model", "document understanding",
]

# Stages and platforms in the order in which plans are picked.
STAGE_ORDER = ["model-plan", "seed", "repository", "paper-index", "social", "homepage", "chinese", "broad", "follow-up", "custom"]
PLATFORM_ORDER = ["github", "homepage", "arxiv", "openreview", "x", "xiaohongshu", "web"]

# Phrases and themes of announcement searches.
PLAN_PHRASES = ['"Introducing"', '"Introducing our paper"', '"our new work"', '"accepted to" "paper"', '"paper accepted"', '"happy to share" "accepted"', '"thrilled to share" "paper"', '"we release" "paper"']
PLAN_THEMES = ["LLM VLM multimodal agent reasoning", "video understanding 3D Gaussian Splatting robotics embodied AI", "VLA vision language action world model", "MLLM benchmark evaluation post-training RL", "multimodal RAG document understanding"]

# Statuses by rank.
STATUS_RANK = {"ignored": 0, "candidate": 1, "accepted": 2, "officially-published": 3}
UNCLASSIFIED = "未分类 / Unclassified"
WAITING = r"waiting for Zhipu enrichment|Discovery evidence found"
CHAT_SOURCE = "zhipu-chat"

# Named references in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&ndash;", "-"), ("&mdash;", "-"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&hellip;", "...")]

# Ranges of the characters that Unicode calls pictographs.
PICTOGRAPHS = [
    (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x2388, 0x2388), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2),
    (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x2605), (0x2607, 0x2612), (0x2614, 0x2685), (0x2690, 0x2705), (0x2708, 0x2712), (0x2714, 0x2714), (0x2716, 0x2716), (0x271D, 0x271D), (0x2721, 0x2721), (0x2728, 0x2728), (0x2733, 0x2734),
    (0x2744, 0x2744), (0x2747, 0x2747), (0x274C, 0x274C), (0x274E, 0x274E), (0x2753, 0x2755), (0x2757, 0x2757), (0x2763, 0x2767), (0x2795, 0x2797), (0x27A1, 0x27A1), (0x27B0, 0x27B0), (0x27BF, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55),
    (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1F0FF), (0x1F10D, 0x1F10F), (0x1F12F, 0x1F12F), (0x1F16C, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F1AD, 0x1F1E5), (0x1F201, 0x1F20F), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F23C, 0x1F23F), (0x1F249, 0x1F3FA), (0x1F400, 0x1F53D), (0x1F546, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F774, 0x1F77F), (0x1F7D5, 0x1F7FF), (0x1F80C, 0x1F80F), (0x1F848, 0x1F84F), (0x1F85A, 0x1F85F), (0x1F888, 0x1F88F), (0x1F8AE, 0x1F8FF),
    (0x1F90C, 0x1F93A), (0x1F93C, 0x1F945), (0x1F947, 0x1FAFF), (0x1FC00, 0x1FFFD),
]
PICTOGRAPH = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in PICTOGRAPHS) + "]"

# Shapes that no clean title has.
DIRTY_TITLE = [
    r"(?i)^github\s+-", r"(?i)^bibtex\s+@", r"(?i)\b(?:title|author|booktitle)\s*=\s*\{", r"(?i)\s##\s*", r"(?i)\b(?:repository files navigation|go to file|last commit|table of contents)\b",
    r"(?i)\b(?:abstract|installation|quickstart|citation)\b", r"(?i)\b(?:this is the (?:code )?repository|if you find our work useful|please consider giving us)\b", r"(?i)\b(?:we introduce|we propose|we present|we release)\b",
    f"(?i){WAITING}", r"(?i)\b(?:识别到|接收信号|标题为|被.*接收|是一个|通过.*提供|没有提供.*证据)\b", r"^[\p{IsHan}\s，。；：:]+$", r"(?i)github\.io|github\.com|https?://", PICTOGRAPH,
]
TITLE_BAD_START = r"(?i)^(?:the|this|official|code|repository|repo|paper|project page|accepted|main conference|conference|findings|poster|oral|pages?|figures?|subjects?)\b"

# Topics of guides (needle, label), families, and result signals by words.
GUIDE_TOPICS = [("computer use", "computer-use agent"), ("web agent", "网页智能体"), ("gui agent", "GUI 智能体"), ("vision-language-action", "VLA 与具身动作"), ("vla", "VLA 与具身动作"), ("robot", "机器人规划"), ("video", "视频理解"), ("hallucination", "幻觉缓解"), ("retrieval", "检索增强"), ("benchmark", "评测基准"), ("reasoning", "复杂推理"), ("world model", "世界模型"), ("multimodal", "多模态理解"), ("mllm", "多模态大模型"), ("vision-language", "视觉语言理解"), ("audio", "音频多模态"), ("speech", "语音多模态"), ("generation", "多模态生成")]
GUIDE_FAMILIES = [("vla", ["vision-language-action", "vla", "embodied"]), ("video", ["video"]), ("vlm", ["vision-language", "vlm"]), ("mllm", ["multimodal", "mllm"]), ("agent", ["agent"]), ("reasoning", ["reasoning"]), ("llm", ["llm", "language model"])]
GUIDE_RESULTS = [("state-of-the-art", ["state of the art", "sota"]), ("outperforms", ["outperform", "surpass"]), ("improves", ["improve", "boost", "increase"]), ("cheaper", ["reduce", "faster", "efficient"]), ("achieves", ["achieve"])]
LIMITATION_WORDS = ["however", "challenge", "limitation", "difficult", "fail", "bias", "suffer", "remain"]

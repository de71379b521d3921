"""The vocabulary a new collection starts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import normalize_tag, tag_slug

# Names and descriptions of the initial tags, in id order.
INITIAL_TAGS = [
    ("AI", "AI 与智能系统"),
    ("AI Engineering", "AI 工程化与应用落地"),
    ("LLM", "大语言模型"),
    ("Agent", "AI Agent 与智能体系统"),
    ("RAG", "检索增强生成"),
    ("Prompt Engineering", "Prompt 设计与上下文工程"),
    ("Machine Learning", "机器学习"),
    ("Deep Learning", "深度学习"),
    ("NLP", "自然语言处理"),
    ("Computer Vision", "计算机视觉"),
    ("Recommendation System", "推荐系统"),
    ("MLOps", "机器学习工程与模型运维"),
    ("AI Safety", "AI 安全、对齐与风险治理"),
    ("Engineering", "工程实践与软件工程"),
    ("Architecture", "架构设计与架构权衡"),
    ("System Design", "系统设计"),
    ("Software Design", "软件设计与设计原则"),
    ("Backend", "后端工程"),
    ("Frontend", "前端工程"),
    ("Mobile", "移动端工程"),
    ("Web", "Web 技术与 Web 平台"),
    ("API Design", "API 设计与接口治理"),
    ("Microservices", "微服务架构"),
    ("Distributed Systems", "分布式系统"),
    ("Computer Systems", "计算机系统"),
    ("Operating Systems", "操作系统"),
    ("Networking", "网络与协议"),
    ("Storage Systems", "存储系统"),
    ("Database", "数据库"),
    ("Query Optimizer", "查询优化器"),
    ("Cache", "缓存系统与缓存策略"),
    ("Message Queue", "消息队列与异步系统"),
    ("Search", "搜索系统与检索技术"),
    ("Data Engineering", "数据工程"),
    ("Data Pipeline", "数据管道"),
    ("Streaming", "流式计算与实时数据"),
    ("Big Data", "大数据系统"),
    ("Data Warehouse", "数据仓库与湖仓"),
    ("Analytics", "分析系统与数据分析"),
    ("Performance", "性能与性能优化"),
    ("Scalability", "可扩展性"),
    ("Reliability", "可靠性工程"),
    ("High Availability", "高可用架构"),
    ("SRE", "SRE 与生产系统运维"),
    ("Observability", "可观测性"),
    ("Monitoring", "监控、告警与诊断"),
    ("Incident Review", "故障复盘与事故分析"),
    ("Testing", "测试与质量保障"),
    ("Code Quality", "代码质量与工程规范"),
    ("Refactoring", "重构与演进式设计"),
    ("CI/CD", "持续集成与持续交付"),
    ("Infrastructure", "基础设施工程"),
    ("Cloud Native", "云原生技术"),
    ("Kubernetes", "Kubernetes 与容器编排"),
    ("DevOps", "DevOps 与工程交付流程"),
    ("Platform Engineering", "平台工程"),
    ("Developer Tools", "开发者工具"),
    ("Engineering Productivity", "工程效率"),
    ("Open Source", "开源项目与开源治理"),
    ("Product Engineering", "产品工程与业务系统工程"),
    ("Security", "安全工程"),
    ("Web Security", "Web 安全"),
    ("AppSec", "应用安全"),
    ("Cryptography", "密码学"),
    ("Privacy", "隐私保护与隐私计算"),
    ("Supply Chain Security", "软件供应链安全"),
    ("Reverse Engineering", "逆向工程"),
    ("Programming Languages", "编程语言"),
    ("Compilers", "编译器"),
    ("Runtime", "运行时系统"),
    ("Algorithms", "算法"),
    ("Theory", "理论计算机科学"),
    ("Data Structures", "数据结构"),
    ("Computer Architecture", "计算机体系结构"),
    ("GPU", "GPU 与异构计算"),
    ("CUDA", "CUDA 与 GPU 编程"),
    ("HPC", "高性能计算"),
    ("Embedded Systems", "嵌入式系统"),
    ("IoT", "物联网"),
    ("Robotics", "机器人"),
    ("Graphics", "图形学与可视化"),
    ("HCI", "人机交互"),
    ("Research", "计算机科研与研究议题"),
    ("Paper Reading", "论文阅读与论文解读"),
    ("Research Method", "科研方法与研究训练"),
    ("Experiment", "实验设计与实验分析"),
    ("Benchmark", "基准测试与评测体系"),
    ("Reproducibility", "复现与可重复性"),
    ("Learning Path", "学习路线"),
    ("CS Education", "计算机教育与课程学习"),
    ("Career", "技术职业发展"),
    ("Interview", "面试与求职"),
    ("Engineering Leadership", "技术领导力"),
    ("Engineering Culture", "工程文化"),
    ("Team Collaboration", "团队协作"),
    ("Productivity", "个人效率与工作流"),
    ("Technical Writing", "技术写作与知识整理"),
]
# Initial slugs that do not follow from the name.
INITIAL_SLUGS = {"CI/CD": "ci-cd"}


def default_vocabulary(spark: SparkSession, as_of: Column) -> DataFrame:
    """The initial tags as vocabulary rows, all active."""
    rows = [(i, name, text, INITIAL_SLUGS.get(name)) for i, (name, text) in enumerate(INITIAL_TAGS, 1)]
    return spark.createDataFrame(rows, "id bigint, name string, description string, given_slug string").select(
        "id", "name",
        normalize_tag(F.col("name")).alias("normalized_name"),
        F.coalesce("given_slug", tag_slug(F.col("name"))).alias("slug"),
        "description",
        F.lit("active").alias("status"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )

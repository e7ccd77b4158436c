"""Constant relations of the Russian legal corpus, for comparisons with published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must equal those that results are compared with.
EVALUATION_GROUPS = {
    "персональные данные": ("персональный", "данные", "субъект", "согласие", "сбор", "обработка"),
    "искусственный интеллект": ("искусственный", "интеллект", "система", "модель", "алгоритм", "риск"),
    "связь": ("связь", "сеть", "оператор", "абонент", "услуга", "устройство"),
    "кибербезопасность": ("кибербезопасности", "угроза", "безопасность", "инцидент", "защита"),
    "цифровая среда": ("цифровой", "объект", "среда", "электронный", "подпись"),
}
ASSOCIATION_PAIRS = (("персональный", "данные"), ("искусственный", "интеллект"), ("электронный", "подпись"), ("оператор", "связь"), ("субъект", "согласие"), ("угроза", "безопасность"))
TYPO = "персональнвй"
QUERY_WORDS = ("данные", "связь", "интеллект", "кибербезопасности", "согласие", "подпись")
EQUATIONS = (
    ("персональный - данные + информация", ("персональный", "информация"), ("данные",)),
    ("оператор - связь + данные", ("оператор", "данные"), ("связь",)),
    ("цифровой - среда + система", ("цифровой", "система"), ("среда",)),
)
SAMPLE_QUERIES = (
    "согласие на обработку персональных данных",
    "защита от угроз кибербезопасности",
    "оператор сети связи оказывает услуги абоненту",
    "риски системы искусственного интеллекта",
    "электронная цифровая подпись",
)
LABEL_NAMES = {
    "access_to_information": "Доступ к информации",
    "artificial_intelligence": "Искусственный интеллект",
    "communications": "Связь",
    "cybersecurity": "Кибербезопасность",
    "digital_code": "Цифровой кодекс",
    "personal_data": "Персональные данные",
}
DOCUMENT_IDS = ("personal_data", "cybersecurity", "communications", "artificial_intelligence", "access_to_information")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, w) for g, words in EVALUATION_GROUPS.items() for w in words], "grp string, word string")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASSOCIATION_PAIRS), "a string, b string")


def label_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABEL_NAMES.items()), "label string, label_name string")

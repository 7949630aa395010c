"""Question analysis, prompt assembly, answering and citations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import CITATION_CHARS, keywords, lookup
from lattica.operators.fusion import pack_context

# Trigger substrings per intent, in the order they are tried.
INTENT_TRIGGERS = {
    "procedural": ("어떻게", "절차", "방법", "how"),
    "comparative": ("차이", "비교", "vs"),
    "definitional": ("무엇", "뭐", "what is"),
    "factual": ("며칠", "몇", "언제"),
    "conditional": ("경우", "만약", "if"),
}
# The kind of answer each intent asks for; any other intent: unknown.
ANSWER_TYPES = {
    "procedural": "list",
    "comparative": "comparison",
    "factual": "single_fact",
    "definitional": "explanation",
}

# The prompt text.
PROMPT_SYSTEM = (
    "당신은 조직의 지식 전문가입니다.\n"
    "제공된 컨텍스트 정보만을 사용하여 질문에 답변하세요.\n"
    "답변에 사용한 정보의 출처를 반드시 [출처: N] 형식으로 명시하세요.\n"
    '컨텍스트에 없는 정보는 "해당 정보를 찾을 수 없습니다"라고 답변하세요.\n'
)
PROMPT_ONTOLOGY = "\n온톨로지 스키마:\n"
PROMPT_INSTRUCTIONS = (
    "1. 컨텍스트를 주의 깊게 읽으세요.\n"
    "2. 질문에 직접 관련된 정보만 사용하세요.\n"
    "3. 답변 작성 시 [출처: N] 형식으로 인용하세요.\n"
    "4. 확실하지 않은 정보는 언급하지 마세요.\n"
)
SOURCE_MARK = "출처"
STREAM_SYSTEM = "당신은 조직의 지식 전문가입니다.\n"
STREAM_WITHOUT_CONTEXT = "질문에 대해 간결하고 정확하게 답변하세요.\n\n질문: "
STREAM_WITH_CONTEXT = (
    "아래 제공된 문서를 참고하여 질문에 답변하세요.\n문서에 없는 내용은 추측하지 마세요.\n\n=== 참고 문서 ===\n"
)
STREAM_QUESTION = "\n\n=== 질문 ===\n"
STREAM_ANSWER = "\n\n답변:"
CITATION_PATTERN = r"\[출처:\s*(\d+)\]"
NOT_FOUND_ANSWER = "해당 정보를 찾을 수 없습니다"


def intent(question: Column) -> Column:
    """First intent one of whose triggers occurs in the question."""
    lowered = F.lower(question)
    branches = None
    for name, triggers in INTENT_TRIGGERS.items():
        found = F.lit(False)
        for trigger in triggers:
            found = found | lowered.contains(trigger)
        branches = F.when(found, name) if branches is None else branches.when(found, name)
    return branches.otherwise("general")


def answer_type(intent_name: Column) -> Column:
    return F.coalesce(lookup(ANSWER_TYPES, intent_name), F.lit("unknown"))


def analyze(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add intent, answer_type and keywords; a projection, no shuffle."""
    return (
        questions.withColumn("intent", intent(F.col(question)))
        .withColumn("answer_type", answer_type(F.col("intent")))
        .withColumn("keywords", keywords(F.col(question)))
    )


def assemble_prompts(
    questions: DataFrame, results: DataFrame, budget: int = 8000, ontology: str | None = None
) -> DataFrame:
    """(request_id, prompt) for every question, with or without results.

    `results` has (request_id, rank, source, content).
    """
    packed = pack_context(results, ["request_id"], [F.col("rank")], budget)
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit(f"] {SOURCE_MARK}: "), F.col("source"), F.lit("\n"),
        F.col("content"), F.lit("\n\n"),
    )
    contexts = packed.groupBy("request_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), ""
        ).alias("context")
    )
    schema = PROMPT_ONTOLOGY + ontology if ontology else ""
    prompt = F.concat(
        F.lit("<s>\n" + PROMPT_SYSTEM + schema + "</s>\n\n<context>\n"),
        F.coalesce(F.col("context"), F.lit("")),
        F.lit("</context>\n\n<question>\n"),
        F.col("question"),
        F.lit("\n</question>\n\n<instructions>\n" + PROMPT_INSTRUCTIONS + "</instructions>\n"),
    )
    return questions.join(contexts, "request_id", "left").select("request_id", prompt.alias("prompt"))


def build_prompt(system: Column, context: Column, question: Column, instructions: Column) -> Column:
    """Tagged prompt from its parts; empty parts leave no tag.

    `context` and `instructions` are arrays of strings.
    """
    numbered = F.transform(instructions, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n")))
    sections = F.transform(context, lambda x: F.concat(x, F.lit("\n\n")))

    def tagged(tag: str, present: Column, body: Column, tail: str) -> Column:
        return F.when(present, F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"</{tag}>{tail}"))).otherwise("")

    return F.concat(
        tagged("s", system != "", F.concat(system, F.lit("\n")), "\n\n"),
        tagged("context", F.size(context) > 0, F.array_join(sections, ""), "\n\n"),
        tagged("question", question != "", F.concat(question, F.lit("\n")), "\n\n"),
        tagged("instructions", F.size(instructions) > 0, F.array_join(numbered, ""), "\n"),
    )


def stream_prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Prompt of the streaming variant: vector results only, numbered documents."""
    entry = F.concat(F.lit("[문서 "), F.col("rank").cast("string"), F.lit("] "), F.col("content"))
    contexts = results.groupBy("request_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))), lambda x: x["entry"]), "\n\n"
        ).alias("context")
    )
    joined = questions.join(contexts, "request_id", "left")
    with_context = F.concat(
        F.lit(STREAM_SYSTEM + STREAM_WITH_CONTEXT), F.col("context"), F.lit(STREAM_QUESTION), F.col("question"), F.lit(STREAM_ANSWER)
    )
    bare = F.concat(F.lit(STREAM_SYSTEM + STREAM_WITHOUT_CONTEXT), F.col("question"), F.lit(STREAM_ANSWER))
    return joined.select("request_id", F.coalesce(with_context, bare).alias("prompt"))


class AnswerModel(Protocol):
    """Language model behind a narrow interface; instances travel to the executors."""

    def generate_batch(self, prompts: list[str]) -> list[str]: ...


def generate(prompts: DataFrame, model: AnswerModel) -> DataFrame:
    """(request_id, answer, error): one failing prompt does not fail the batch."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            try:
                answers, errors = list(model.generate_batch(texts.tolist())), [None] * len(texts)
                if len(answers) != len(texts):
                    raise ValueError("not one answer per prompt")
            except Exception:
                # Some prompt failed: one at a time, so that it fails alone.
                answers, errors = [], []
                for text in texts:
                    try:
                        answers.append(model.generate_batch([text])[0])
                        errors.append(None)
                    except Exception as problem:
                        answers.append(None)
                        errors.append(str(problem))
            yield pd.DataFrame({"answer": answers, "error": errors})

    return prompts.select("request_id", run("prompt").alias("_out")).select("request_id", "_out.*")


def extractive_answers(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Default answers without a language model: the sources, quoted in rank order."""
    quote = F.concat(
        F.substring("content", 1, CITATION_CHARS), F.lit(f" [{SOURCE_MARK}: "), F.col("rank").cast("string"), F.lit("]")
    )
    quoted = results.groupBy("request_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", quote.alias("quote")))), lambda x: x["quote"]), "\n"
        ).alias("answer")
    )
    return questions.join(quoted, "request_id", "left").select(
        "request_id", F.coalesce("answer", F.lit(NOT_FOUND_ANSWER)).alias("answer")
    )


def cited_numbers(answer: Column) -> Column:
    """Distinct source numbers an answer cites, ascending."""
    found = F.regexp_extract_all(answer, F.lit(CITATION_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.try_cast("bigint"))))


def citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """One row per source an answer cites; numbers without a result vanish in the join."""
    cited = answers.select("request_id", F.explode(cited_numbers(F.col("answer"))).alias("rank"))
    sources = results.withColumn("rank", F.col("rank").cast("bigint"))
    return cited.join(sources, ["request_id", "rank"]).select(
        "request_id",
        F.col("rank").alias("citation"),
        F.substring("content", 1, CITATION_CHARS).alias("quote"),
        "source",
        F.concat(F.lit("Document "), F.col("source")).alias("document_title"),
    )

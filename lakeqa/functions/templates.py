"""Prompt texts and template filling."""

import re

from pyspark.sql import Column, functions as F

TEMPLATES = ("QTTT", "TTTQ", "QTQTQT")
MODES = ("closed-book", "oracle", "open-book")

# Prompt texts. Requests are found again by the digest of their text, so these must
# stay exactly as they are.
CLOSED_BOOK = {
    "aitqa": """Answer in following format {"answer": "<your-answer>"}. Use one word or a phrase to answer the query. Query: {{query}}""",
    "nqtables": """Answer in following format {"answer": "<your-answer>"}. Use one word or a phrase to answer the question. Query: {{query}}""",
}
WITH_TABLES = {
    ("QTTT", "oracle"): """Answer in following format {"answer": "<your-answer>"}. Answer the query below based on the table. Only extract the answer from one table cell. Do not generate a sentence. Query: {{query}} Context: {{context}}""",
    ("QTTT", "open-book"): """Answer in following format {"answer": "<your-answer>"}. Answer the query below based on the tables. Only extract the answer from one table cell. Do not generate a sentence. Query: {{query}} Context: {{context}}""",
    ("TTTQ", "oracle"): """Answer in following format {"answer": "<your-answer>"}. Answer the query below based on the table. Only extract the answer from one table cell. Do not generate a sentence. Context: {{context}} Query: {{query}}""",
    ("TTTQ", "open-book"): """Answer in following format {"answer": "<your-answer>"}. Answer the query below based on the tables. Only extract the answer from one table cell. Do not generate a sentence. Context: {{context}} Query: {{query}}""",
    ("QTQTQT", "oracle"): """Answer in following format {"answer": "<your-answer>"}. Answer the query below based on the table. Only extract the answer from one table cell. Do not generate a sentence. Context: {{context}}""",
    ("QTQTQT", "open-book"): """Answer in following format {"answer": "<your-answer>"}. Answer the query below based on the tables. Only extract the answer from one table cell. Do not generate a sentence. Context: {{context}}""",
}
ANSWER_SYSTEM = "You are a helpful assistant that answers questions based on information stored in tables."
ZOOM_SYSTEM = """You are a data specialist who selects relevant tables that may help answer a given question.
Select the specified number of tables that you believe are most likely to contain the answer to the given question. Order them from most likely to least likely.
Provide the table_id strings of these tables formatted as a JSON list: ["table_id_1", "table_id_2", "..."]
Provide only the JSON without any explanations."""
ZOOM_PROMPT = """Provide the table_id strings of the top {{next_focus_size}} that most likely contain the answer to the following question:

{{query}}

{{tables}}
"""
QUESTIONS_SYSTEM = """You are a chatbot that generates questions from tables. Provide only the generated questions in the following json format without any explanation: {"<table_id>": ["<question1_text>", "<question2_text>", ..., "<question10_text>"]}! IMPORTANT: Do not change the provided table id!"""
QUESTIONS_PROMPT = {
    "aitqa": """Generate 10 questions from the table at the end of the prompt. Include the airline name in the questions: {{airline_name}}. Use the provided table id exactly as shown here: "{{table_id}}". Table: {{table}}""",
    "nqtables": """Generate 10 questions from the table at the end of the prompt. Use the provided table id exactly as shown here: "{{table_id}}". Table: {{table}}""",
}

# Defaults of the request fields.
ANSWER_TOKENS = 70
ZOOM_TOKENS = 1000
QUESTIONS_TOKENS = 400
BUFFER_TOKENS = 100
MODEL_SEED = 732172265


def fill(template: str, **values: Column) -> Column:
    """Replace each ``{{name}}`` by a column. Values are inserted once and never expanded again."""
    pieces = re.split(r"\{\{([^{}]+)\}\}", template)
    columns = []
    for at, piece in enumerate(pieces):
        if at % 2 == 0:
            columns.append(F.lit(piece))
        elif piece in values:
            columns.append(values[piece])
        else:
            raise KeyError(f"no value for template variable {piece}")
    return F.concat(*columns)


def answer_template(template: str, dataset: str, mode: str) -> str:
    if template not in TEMPLATES or mode not in MODES or dataset not in CLOSED_BOOK:
        raise ValueError(f"unknown prompt: {template}, {dataset}, {mode}")
    return CLOSED_BOOK[dataset] if mode == "closed-book" else WITH_TABLES[template, mode]

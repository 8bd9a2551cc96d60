"""Prompt templates.

Text that must equal the reference's prompts character for character
(indentation, blank lines and trailing spaces included).  ``{question}``,
``{context}`` and ``{json_table}`` are the slots filled by ``kvlens.operators.prompts``.
"""

# Q1: sequence-to-sequence input (fine-tuned and zero-shot T5 / BART)
SEQ2SEQ = (
    'question: {question} </s> context: {context} </s>'
)

# Q2: one worked example, answer only
FEW_SHOT = (
    '\n'
    '    Answer the question based on the context provided also give the reason for the answer (take the current year as 2022)\n'
    '\n'
    '    question : \n'
    '    How old was Charles Brenton Huggins when he won the Nobel Prize in 1966?\n'
    '    \n'
    '    context : ***category\n'
    '    nobel\n'
    '\n'
    '    Charles Brenton Huggins\n'
    '    Born\t( | 1901-09-22 | ) | September 22, 1901 | Halifax, Nova Scotia\n'
    '    Citizenship\tCanadian / American\n'
    '    Awards\tNobel Prize for Physiology or Medicine | (1966) | Gairdner Foundation International Award | (1966)\n'
    "    ['Charles Brenton Huggins nobel.jpg | Charles Brenton Huggins']***\n"
    '    answer: 65 years\n'
    '    ###\n'
    '    question : {question} \n'
    '    context : ***{context}***\n'
    '    answer: '
)

# Q3: one worked example with reasoning
FEW_SHOT_REASONING = (
    '\n'
    '    Answer the question based on the context provided also give the reason for the answer (take the current year as 2022)\n'
    '\n'
    '    question : \n'
    '    How old was Charles Brenton Huggins when he won the Nobel Prize in 1966?\n'
    '    \n'
    '    context : ***category\n'
    '    nobel\n'
    '\n'
    '    Charles Brenton Huggins\n'
    '    Born\t( | 1901-09-22 | ) | September 22, 1901 | Halifax, Nova Scotia\n'
    '    Citizenship\tCanadian / American\n'
    '    Awards\tNobel Prize for Physiology or Medicine | (1966) | Gairdner Foundation International Award | (1966)\n'
    "    ['Charles Brenton Huggins nobel.jpg | Charles Brenton Huggins']***\n"
    '    reasoning and answer: Charles was born in 1901 and he won the price in 1966, thus he was 65 years old. (1966 - 1901). The answer is 65 years old.\n'
    '    ###\n'
    '    question : {question} \n'
    '    context : ***{context}***\n'
    '    reasoning and answer: '
)

# Q4: chat zero-shot, 1-10 words, reference year 2022
CHAT_ZERO_SHOT = (
    '\n'
    '    Answer the question based on the context provided (take the current year as 2022)\n'
    '    generate only the relevant answer do not include the question and unnecessary verbs in it thus generate small answer within 1 to 10 words.\n'
    '\n'
    '    question : {question}\n'
    '    context : ***{context}***\n'
    '    answer : '
)

# Q7: chat zero-shot with a no-preamble rule
CHAT_NO_PREAMBLE = (
    '\n'
    '    Answer the question based on the context provided (take the current year as 2022)\n'
    '    generate small answer within 1 to 10 words\n'
    '    do not include verb in the answer\n'
    "    do not add the phrase Sure! Here's a small answer within 1 to 10 words:\n"
    '\n'
    '    question : {question}\n'
    '    context : ***{context}***\n'
    '    answer : '
)

# Q8: triple-extraction request
TRIPLE_REQUEST = (
    ' Convert the following json into a knowledge graph with subject, predicate and object json  {json_table}'
)

# Q5: chat few-shot, two worked examples (a commented-out variant there)
CHAT_FEW_SHOT = (
    '\n'
    '    Answer the questions based on the context provided (take the current year as 2022)\n'
    '    questions : How old was Charles Brenton Huggins when he won the Nobel Prize in 1966?\n'
    '\n'
    '    context : ***category\n'
    '    nobel\n'
    '\n'
    '    Charles Brenton Huggins\n'
    '    Born\t( | 1901-09-22 | ) | September 22, 1901 | Halifax, Nova Scotia\n'
    '    Citizenship\tCanadian / American\n'
    '    Awards\tNobel Prize for Physiology or Medicine | (1966) | Gairdner Foundation International Award | (1966)\n'
    "    ['Charles Brenton Huggins nobel.jpg | Charles Brenton Huggins']***\n"
    '    answers : 65 years old\n'
    '\n'
    '    ###\n'
    '    question : When was the last time that Frederick John Perry won the Davis Cup?\n'
    '    context : ***category\n'
    '    tennis\n'
    '\n'
    '    Full name\n'
    '    Frederick John Perry\n'
    '\n'
    '    Died\n'
    '    2 February 1995 | (1995-02-02) | (aged 85) | Melbourne, Victoria, Australia\n'
    '\n'
    '    Team competitions\n'
    '    Davis Cup\tW | (1933, 1934, 1935, 1936)***\n'
    '    answer : 1936\n'
    '    ###\n'
    '    question : {question}\n'
    '    context : ***{context}***\n'
    '    answer :'
)

# Q6: chat with reasoning, 'answer && reason' (a commented-out variant there)
CHAT_REASONING = (
    '\n'
    '    Answer the question based on the context provided (take the current year as 2022)\n'
    '    generate only the relevant answer do not include the question and unnecessary verbs in it thus generate small answer within 1 to 10 words.\n'
    '    Also give the proper reasoning with the answer, first answer then the reason for the generated answer.\n'
    '\n'
    '    question :\n'
    '    How old was Charles Brenton Huggins when he won the Nobel Prize in 1966?\n'
    '\n'
    '    context : ***category\n'
    '    nobel\n'
    '\n'
    '    Charles Brenton Huggins\n'
    '    Born\t( | 1901-09-22 | ) | September 22, 1901 | Halifax, Nova Scotia\n'
    '    Citizenship\tCanadian / American\n'
    '    Awards\tNobel Prize for Physiology or Medicine | (1966) | Gairdner Foundation International Award | (1966)\n'
    "    ['Charles Brenton Huggins nobel.jpg | Charles Brenton Huggins']***\n"
    '    answer and reasoning: 65 years old && Charles was born in 1901 and he won the price in 1966, thus he was 65 years old. (1966 - 1901)\n'
    '    ###\n'
    '    question : When was the last time that Frederick John Perry won the Davis Cup?\n'
    '    context : ***category\n'
    '    tennis\n'
    '\n'
    '    Full name\n'
    '    Frederick John Perry\n'
    '\n'
    '    Died\n'
    '    2 February 1995 | (1995-02-02) | (aged 85) | Melbourne, Victoria, Australia\n'
    '\n'
    '    Team competitions\n'
    '    Davis Cup\tW | (1933, 1934, 1935, 1936)***\n'
    '    answer and reasoning: 1936 && He won the davis cup four times among them 1936 is the lastest year in which he won.\n'
    '    ###\n'
    '    question : {question}\n'
    '    context : ***{context}***\n'
    '    answer and reasoning: '
)

TEMPLATES = {
    'seq2seq': SEQ2SEQ,
    'few_shot': FEW_SHOT,
    'few_shot_reasoning': FEW_SHOT_REASONING,
    'chat_zero_shot': CHAT_ZERO_SHOT,
    'chat_no_preamble': CHAT_NO_PREAMBLE,
    'triple_request': TRIPLE_REQUEST,
    'chat_few_shot': CHAT_FEW_SHOT,
    'chat_reasoning': CHAT_REASONING,
}

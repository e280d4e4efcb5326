"""Mails and model responses composed from the ``documents`` and ``conversations`` tables.

The given tables hold prose without any mail furniture, so every document becomes a mail: its
whole text with a greeting, closing, signature, disclaimer and reply header around it. The
select lists are portable SQL; the checks run the same lists in another engine. Rules for the
lists: no backslash in a literal, ``chr(10)`` for a line break, no NULL operand in ``concat``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

TEXT_BODY = """concat(
    case doc_id % 5 when 0 then concat('Hi Support Team,', chr(10)) when 1 then concat('Dear Sir,', chr(10)) when 2 then concat('Good morning,', chr(10)) when 3 then concat('To whom it may concern', chr(10)) else '' end,
    text, chr(10),
    case doc_id % 9 when 0 then concat('Wait!!!! what???? well....', chr(10), '[image: logo.png]', chr(10), '[cid:abc123]', chr(10), 'cid:part1', chr(10)) when 1 then concat('If you have any questions call me', chr(10)) when 2 then concat('  > quoted inline', chr(10), '> quoted', chr(10), '> > twice', chr(10)) else '' end,
    case doc_id % 7 when 0 then concat('Thanks,', chr(10)) when 1 then concat('Best regards,', chr(10)) when 2 then concat('Looking forward to it', chr(10)) else '' end,
    case doc_id % 11 when 0 then concat('Director, Customer Success', chr(10), 'john.doe@example.com', chr(10), '+966 55 123 4567', chr(10)) when 1 then concat('--', chr(10), 'John Doe', chr(10)) when 2 then concat('Sent from my BlackBerry', chr(10)) when 3 then concat('Sent from my iPhone', chr(10)) else '' end,
    case doc_id % 13 when 0 then concat('DISCLAIMER: for the addressee only', chr(10)) when 1 then concat('This email and any attachments are confidential', chr(10)) when 2 then concat('-----CONFIDENTIAL NOTICE-----', chr(10), 'second line survives', chr(10)) when 3 then concat('This email has been scanned for viruses', chr(10)) when 4 then concat('Company Confidential', chr(10)) when 5 then concat('***** legal notice *****', chr(10)) else '' end,
    case cast(floor(doc_id / 8) as bigint) % 6 when 0 then concat('On Mon, Jan 5, 2024 at 9:00 John wrote:', chr(10), '> earlier text', chr(10)) when 1 then concat('-----Original Message-----', chr(10), 'old', chr(10)) when 2 then concat('From: a', chr(10), 'Sent: b', chr(10), 'To: c', chr(10)) when 3 then concat('____________', chr(10), 'old', chr(10)) when 4 then concat('>> nested', chr(10)) else '' end
  )"""

HTML_BODY = f"""case doc_id % 8
    when 3 then concat('<html><head><title>t</title><style>p {{ color: red }}</style></head><body><p>', replace({TEXT_BODY}, chr(10), '<br>'), '</p><table><tr><td>Ref</td><td>A&amp;B</td></tr><tr><th>Total</th><td>10&nbsp;&euro; &#8212; &#x263A;</td></tr></table><ul><li>one</li><li><a href="http://x.example/">two</a></li></ul><img src="p.gif" width="1" height="1"><!-- note --></body></html>')
    when 5 then concat('<div>', replace({TEXT_BODY}, chr(10), concat('</div>', chr(13), chr(10), '<div>')), '</div><blockquote type="cite">old words</blockquote><o:p> </o:p>')
    when 7 then case when n_chars < 100 then concat('<p>', lang, '</p>') else {TEXT_BODY} end
    else {TEXT_BODY} end"""

EMAILS = [
    "case when n_chars % 97 = 0 then null else doc_id end as rec_id",
    "case when doc_id % 8 = 0 then 'مشكلة في الحساب' when doc_id % 17 = 0 then null else concat('Ticket ', cast(doc_id as string), ' ', source) end as subject",
    "case when doc_id % 10 = 9 then 'Invoices' else 'Tickets' end as type",
    "n_chars % 5000 as created_minute",
    f"case when n_chars % 89 = 0 then null else {HTML_BODY} end as body_html",
]

# The same mails as they land, all text, some of them unfit; and how long their replies took, as text.
LANDED = [
    "doc_id",
    "case when n_chars % 97 = 0 then null when doc_id % 31 = 0 then concat('no. ', cast(doc_id as string)) else concat(' ', cast(doc_id as string)) end as landed_id",
    "case when doc_id % 29 = 0 then 'soon' when doc_id % 23 = 0 then null else '2024-01-01 00:00:00' end as created",
    "case when doc_id % 37 = 0 then 'slow' when doc_id % 37 = 1 then '99999999999' when doc_id % 37 = 2 then '-5' when doc_id % 37 = 3 then null else '70' end as latency",
]

CONFIDENCE = "concat('0.', lpad(cast(n_chars % 100 as string), 2, '0'))"

# One response row per document. NULL stands for a call that failed.
ANALYSIS = f"""case doc_id % 14
    when 0 then concat('```json', chr(10), '{{"classification":{{"category":"billing","priority":"high","sentiment":"negative","confidence":', {CONFIDENCE}, '}},"structured_data":{{"account":{{"value":"A-', cast(n_chars as string), '","confidence":0.8}},"origin":{{"value":"', source, '","confidence":0.25}},"confidence":0.85}},"action_items":[{{"action":"refund","confidence":0.9}}],"summary":"Refund wanted.","confidence_scores":{{"overall":0.91,"classification":0.92,"structured_data":0.85,"action_items":0.9}}}}', chr(10), '```')
    when 1 then concat('Sure, here it is: {{"classification":{{"category":"complaint","priority":"urgent","sentiment":"frustrated","confidence":0.88}},"summary":"Angry about ', source, '.","confidence_scores":{{"overall":', {CONFIDENCE}, '}}}} Hope this helps')
    when 2 then 'I cannot help with that'
    when 3 then '{{"classification":{{"category":"billing","confidence":0.9}},"summary":"No scores."}}'
    when 4 then '{{"classification":{{"category":"feedback","priority":"low","sentiment":"positive","confidence":null}},"summary":"x","confidence_scores":{{"overall":null}}}}'
    when 5 then '{{"classification":{{"category":"billing","priority":"low","sentiment":"neutral","confidence":0.9}},"summary":"Zero.","confidence_scores":{{"overall":0}}}}'
    when 6 then concat('{{"classification":{{"category":"other","priority":"low","sentiment":"neutral","confidence":', {CONFIDENCE}, '}},"summary":"Other.","confidence_scores":{{"overall":0.9}}}}')
    when 7 then concat('{{"classification":{{"category":"billing","priority":"medium","sentiment":"neutral","confidence":', {CONFIDENCE}, '}},"summary":"Medium.","confidence_scores":{{"overall":0.9}}}}')
    when 8 then '{{"classification":{{"category":"billing","priority":"low","sentiment":"neutral","confidence":0.9}},"action_items":[],"summary":"No items.","confidence_scores":{{"overall":0.9,"action_items":0.9}}}}'
    when 9 then '{{"classification":{{"category":"spam","priority":"low","sentiment":"neutral","confidence":"0.9"}},"action_items":[{{"action":"a","confidence":1.4}},{{"action":"b","confidence":-0.2}},{{"action":"c"}}],"summary":"Range.","confidence_scores":{{"overall":1.7,"classification":"0.9","structured_data":-1}}}}'
    when 10 then concat('{{"classification":{{"category":"product_inquiry","priority":"low","sentiment":"neutral","confidence":0.9}},"confidence_scores":{{"overall":', {CONFIDENCE}, '}}}}')
    when 11 then '{{"classification":{{"category":"billing","confidence":0.9}},"action_items":{{"action":"a"}},"summary":"Bad items.","confidence_scores":{{"overall":0.9}}}}'
    when 12 then '{{"classification":"billing","summary":"Bad class.","confidence_scores":{{"overall":0.9}}}}'
    else null end"""

RESPONSES = [
    "doc_id as rec_id",
    f"{ANALYSIS} as analysis_text",
    "case doc_id % 4 when 0 then concat('\"Summary: it', chr(39), 's about billing\"') when 1 then concat('A plain summary of ', lang, ' text.') when 2 then '' else null end as summary_text",
    f"case doc_id % 5 when 0 then concat('{{\"action\":\"Create new ticket\",\"confidence\":', {CONFIDENCE}, ',\"reasoning\":\"clear\"}}') when 1 then '{{\"confidence\":0}}' when 2 then 'no json' when 3 then '{{\"action\":\"Close it\",\"confidence\":7}}' else null end as action_text",
    "case when doc_id % 24 = 0 then null when doc_id % 16 = 0 then concat(chr(10), 'Hello support', chr(10), 'Please help') else concat('Account problem ', lang, chr(10), chr(10), 'Hello support, I cannot sign in.') end as translation_text",
    "100 + doc_id % 50 as in_tokens",
    "20 + doc_id % 7 as out_tokens",
    "30 + n_chars % 11 as plan_in_tokens",
    "5 + n_chars % 3 as plan_out_tokens",
    "60 + n_chars % 13 as summary_in_tokens",
    "case when n_chars % 10 = 0 then null else 9 end as summary_out_tokens",
    "n_chars as translation_in_tokens",
    "n_chars + 3 as translation_out_tokens",
    "50 + doc_id % 400 as latency_ms",
]

# Replies with members beyond the expected ones, and values of unexpected types.
OPEN_RESPONSES = [
    "doc_id as rec_id",
    """case doc_id % 9
      when 0 then concat('{"action_items":[{"action":"refund","confidence":0.9,"due":"2024-05-01","owner":{"id":7,"name":"', source, '"}}],"classification":{"category":"billing","confidence":1.5,"priority":"high","sentiment":"negative","subcategory":"charged twice","tags":["a","b",null]},"confidence_scores":{"overall":0.9},"structured_data":{"account":{"confidence":0.8,"unit":"x","value":"A1"},"confidence":0.85,"list":[1,{"a":2}],"n":', cast(n_chars as string), ',"nothing":null,"ok":true},"summary":"s"}')
      when 1 then '{"action_items":[null,0,"",false,[],[1],{"action":"a","confidence":"high"},{}],"classification":{"confidence":0.9},"confidence_scores":{"overall":0.9},"summary":"s"}'
      when 2 then concat('{"classification":{"category":"other","confidence":0.95,"note":"', lang, '"},"confidence_scores":{"overall":0.9},"structured_data":["x",{"k":1}],"summary":"s"}')
      when 3 then '{"confidence_scores":{"overall":0.9},"structured_data":"ab","summary":"s"}'
      when 4 then '{"classification":[1,2],"confidence_scores":{"overall":0.9},"structured_data":5,"summary":"s"}'
      when 5 then '{"classification":null,"confidence_scores":{"overall":0.9},"structured_data":{"confidence":{"low":1},"name":"x"},"summary":"s"}'
      when 6 then '{"action_items":"","classification":{"confidence":-2,"extra":{"deep":{"er":[true]}}},"confidence_scores":{"overall":0.9},"structured_data":{"confidence":0},"summary":"s"}'
      when 7 then concat('no reply for ', lang)
      else null end as analysis_text""",
]

# A second text source for the one-text form of the translation job.
MESSAGES = [
    "conv_id",
    "turn",
    "case when turn % 3 = 0 then concat('مرحبا ', text) else text end as text",
    "case when conv_id % 5 = 0 then null else concat(' ', chr(10), 'Translated: ', text, ' ') end as translation_text",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compose_emails(documents: DataFrame) -> DataFrame:
    """Mails; ``created_ts`` has no time zone, like the timestamps of the given tables."""
    mails = documents.selectExpr(*EMAILS)
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, created_minute, 0)")
    return mails.withColumn("created_ts", created).drop("created_minute")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose_emails(table(spark, sf_dir, "documents"))


def landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mails as text, and the replies with their latency as text."""
    docs = table(spark, sf_dir, "documents")
    mails = docs.selectExpr(*LANDED, *[c for c in EMAILS if c.split(" as ")[-1] in ("subject", "type", "body_html")])
    replies = responses(spark, sf_dir).join(docs.selectExpr("doc_id as rec_id", LANDED[-1]), "rec_id")
    return mails.withColumnRenamed("landed_id", "rec_id").drop("doc_id", "latency"), replies


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*RESPONSES)


def open_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*OPEN_RESPONSES)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*MESSAGES)


# Mails whose hidden elements are nested, crossed or left open, around whole documents.
HIDDEN = [
    "doc_id",
    """case doc_id % 12
      when 0 then concat('<div>', text, '<blockquote type="cite">old ', source, '</div><p>still mine</p>')
      when 1 then concat('<nav>one<nav>two</nav>three</nav>', text)
      when 2 then concat('<html><head><title>t</title><body>', text, '</body></html>')
      when 3 then concat('<p>', text, '<noscript>hidden', lang)
      when 4 then concat('<ul><li>first<canvas>x</li><li>', text, '<li>last</ul>')
      when 5 then concat('<svg width="1"><path d="m"/><g/></svg>', text, '<SVG/>end')
      when 6 then concat('<blockquote type=cite>a<blockquote>b</blockquote>c</blockquote>', text, '</blockquote>tail')
      when 7 then concat('<table><tr><td>', text, '<iframe src="a>b">inner<td>next</table>after')
      when 8 then concat('<div><nav>menu<div>deep</nav>kept</div>', text, '<nav/>gone</nav>')
      when 9 then concat('<p>', text, '</p><head><style>p { color: red }')
      when 10 then concat('<p>', text, '<canvas></p>x</canvas>y<svg><canvas/>z</svg><blockquote>quoted</blockquote>')
      else concat('<ul><li><nav>a<li>b</nav>', text, '</li></ul><iframe><script>"</iframe>"</script></iframe>end') end as html""",
]


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*HIDDEN)


# Landed JSON pages: every shape a source can send, broken ones included, around whole documents.
ESCAPED_TEXT = (
    "replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), chr(10), concat(chr(92), 'n'))"
)
MAIL_JSON = (
    "concat('{\"RecId\":', cast(doc_id as string), ',\"Subject\":\"Ticket ', source, '\",\"Comments\":\"',"
    f" {ESCAPED_TEXT}, '\",\"Type\":\"Tickets\",\"CreatedDateTime\":\"2024-01-01T00:00:00Z\"}}')"
)
SHORT_JSON = "concat('{\"RecId\":', cast(1000000 + doc_id as string), ',\"Subject\":null}')"
ENVELOPES = [
    "doc_id as page_no",
    f"""case doc_id % 13
      when 0 then concat('{{"Data":[', {MAIL_JSON}, '],"TotalCount":1}}')
      when 1 then concat('{{"Items":[', {MAIL_JSON}, ',', {SHORT_JSON}, '],"TotalCount":', cast(n_chars as string), '}}')
      when 2 then concat('[', {MAIL_JSON}, ',', {SHORT_JSON}, ']')
      when 3 then '{{"Message":"none"}}'
      when 4 then '{{"Data":null,"Items":null}}'
      when 5 then concat('{{"Data":[', {SHORT_JSON}, ',', {MAIL_JSON}, ']}}')
      when 6 then '{{"Data":[],"Items":[]}}'
      when 7 then concat('{{"Items":[', {SHORT_JSON}, ']}}')
      when 8 then concat('{{"Data":[5,null,"x",', {SHORT_JSON}, ',{{"RecId":"', cast(doc_id as string), '","Subject":7}},[]],"TotalCount":"12"}}')
      when 9 then concat('{{"Data":[{{"RecId":"none"}},{{"Subject":"', source, '"}}],"Items":[7,{{"RecId":" ', cast(doc_id as string), ' "}}]}}')
      when 10 then concat('{{"Data":[', {MAIL_JSON}, ',{{"RecId"')
      when 11 then ''
      else null end as payload""",
]


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*ENVELOPES)

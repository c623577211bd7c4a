"""Built-in watchlist: fixed values, stated as plain text.

One line per entry. The dimension blocks are ``code|label``; the target blocks
are ``name|...`` with list members separated by commas.
"""

from __future__ import annotations


def pairs(block: str) -> list[tuple[str, ...]]:
    """Lines of a text block, cut at ``|``."""
    return [tuple(line.split("|")) for line in block.strip().splitlines()]


# Equipment-authorization grantee code -> company.
GRANTEES = pairs(
    """
BCG|Apple (AAPL)
A3L|Samsung
YCVQ2|Google (GOOGL)
2AGOZ|Meta/Oculus (META)
2AFIW|Meta Reality Labs (META)
C3K|Microsoft (MSFT)
2ABYE|Amazon Devices (AMZN)
Z4G|Amazon Lab126 (AMZN)
VOB|NVIDIA (NVDA)
2ABCB|Tesla (TSLA)
2AC7Z|SpaceX/Starlink
PY7|Sony/PlayStation
RLUW|Nintendo
BEJEP|Qualcomm (QCOM)
Q87|Samsung Electronics
R7PEA|Broadcom (AVGO)
2ADNG|Snap Inc (SNAP)
2AA3B|Sonos
2AHDO|Roku (ROKU)
2AC23|Rivian (RIVN)
2ADZM|Ring/Amazon (AMZN)
"""
)

# Trademark owner -> ticker.
TRADEMARK_OWNERS = pairs(
    """
Apple Inc.|AAPL
Google LLC|GOOGL
Alphabet Inc.|GOOGL
Microsoft Corporation|MSFT
Meta Platforms|META
Amazon Technologies|AMZN
Amazon.com|AMZN
NVIDIA Corporation|NVDA
Tesla, Inc.|TSLA
Salesforce|CRM
Adobe Inc.|ADBE
Oracle|ORCL
Palantir Technologies|PLTR
Snowflake Inc.|SNOW
CrowdStrike|CRWD
Coinbase|COIN
Snap Inc.|SNAP
Pinterest|PINS
Block, Inc.|XYZ
Shopify|SHOP
Uber Technologies|UBER
Airbnb|ABNB
Netflix|NFLX
Spotify|SPOT
Roblox|RBLX
Unity Technologies|U
Qualcomm|QCOM
Broadcom|AVGO
Intel Corporation|INTC
Advanced Micro Devices|AMD
Cloudflare|NET
Datadog|DDOG
MongoDB|MDB
Twilio|TWLO
Atlassian|TEAM
HubSpot|HUBS
ServiceNow|NOW
Workday|WDAY
Intuit|INTU
Palo Alto Networks|PANW
Fortinet|FTNT
Zscaler|ZS
SentinelOne|S
Okta|OKTA
Zoom Video|ZM
DocuSign|DOCU
Dropbox|DBX
DoorDash|DASH
Robinhood|HOOD
PayPal|PYPL
Reddit|RDDT
Duolingo|DUOL
AppLovin|APP
Trade Desk|TTD
Rivian|RIVN
Lucid Motors|LCID
C3.ai|AI
SoundHound|SOUN
UiPath|PATH
IonQ|IONQ
Rigetti|RGTI
Anthropic|Private
OpenAI|Private
xAI|Private
Perplexity|Private
"""
)

# Ticker -> filer number. PINS and DUOL share one number.
FILERS = pairs(
    """
AAPL|0000320193
GOOGL|0001652044
MSFT|0000789019
META|0001326801
AMZN|0001018724
NVDA|0001045810
TSLA|0001318605
NFLX|0001065280
CRM|0001108524
ADBE|0000796343
ORCL|0001341439
AMD|0000002488
INTC|0000050863
PLTR|0001321655
SNOW|0001640147
CRWD|0001535527
NET|0001477333
DDOG|0001561550
SHOP|0001594805
COIN|0001679788
HOOD|0001783879
UBER|0001543151
ABNB|0001559720
SNAP|0001564408
PINS|0001562088
RDDT|0001713445
SPOT|0001639920
RBLX|0001315098
ZM|0001585521
PYPL|0001633917
DASH|0001792789
PANW|0001327567
ZS|0001713683
OKTA|0001660134
MDB|0001441816
TWLO|0001447669
ESTC|0001707753
TEAM|0001650372
NOW|0001373715
WDAY|0001327811
INTU|0000896878
QCOM|0000804328
AVGO|0001649338
ARM|0001973239
MU|0000723125
DUOL|0001562088
APP|0001498547
TTD|0001671933
IONQ|0001812364
S|0001804220
FTNT|0001262039
DBX|0001467623
DOCU|0001261654
RIVN|0001874178
AI|0001577526
SOUN|0001840856
PATH|0001734722
ROKU|0001428439
TOST|0001650164
U|0001810806
HUBS|0001404655
CFLT|0001816613
GTLB|0001653482
DOCN|0001582961
"""
)

# Npm package -> company.
NPM_PACKAGES = pairs(
    """
openai|OpenAI
@openai/agents|OpenAI
@anthropic-ai/sdk|Anthropic
@anthropic-ai/bedrock-sdk|Anthropic
@google/generative-ai|Google (GOOGL)
@google-cloud/aiplatform|Google (GOOGL)
@google-cloud/vertexai|Google (GOOGL)
@azure/openai|Microsoft (MSFT)
@microsoft/teams-js|Microsoft (MSFT)
@microsoft/microsoft-graph-client|Microsoft (MSFT)
@llama-stack/client|Meta (META)
@facebook/react|Meta (META)
@aws-sdk/client-bedrock-runtime|Amazon (AMZN)
@aws-sdk/client-bedrock|Amazon (AMZN)
stripe|Stripe
@shopify/hydrogen|Shopify (SHOP)
@shopify/cli|Shopify (SHOP)
wrangler|Cloudflare (NET)
@cloudflare/ai|Cloudflare (NET)
@slack/web-api|Salesforce/Slack (CRM)
@notionhq/client|Notion
@figma/plugin-typings|Figma
@supabase/supabase-js|Supabase
firebase|Google (GOOGL)
@vercel/sdk|Vercel
"""
)

# PyPI package -> company.
PYPI_PACKAGES = pairs(
    """
openai|OpenAI
anthropic|Anthropic
google-generativeai|Google (GOOGL)
google-cloud-aiplatform|Google (GOOGL)
boto3|Amazon (AMZN)
azure-ai-inference|Microsoft (MSFT)
langchain|LangChain
langchain-core|LangChain
llama-index|LlamaIndex
transformers|Hugging Face
torch|Meta/PyTorch (META)
tensorflow|Google (GOOGL)
crewai|CrewAI
stripe|Stripe
snowflake-connector-python|Snowflake (SNOW)
databricks-sdk|Databricks
palantir-sdk|Palantir (PLTR)
salesforce-bulk|Salesforce (CRM)
crowdstrike-falconpy|CrowdStrike (CRWD)
"""
)

# name|ticker|board kind|board id or url|keywords.
JOB_BOARDS = pairs(
    """
OpenAI||greenhouse|openai|robotics,hardware,search,agent,safety,alignment,government
Anthropic||greenhouse|anthropic|agent,safety,enterprise,government,product,hardware
Google DeepMind|GOOGL|lever|deepmind|gemini,robotics,agent,hardware,quantum
Meta AI|META|careers|https://www.metacareers.com/jobs?q=AI&teams[0]=Artificial%20Intelligence|llama,ar,vr,robotics,agent,quest,orion
xAI||lever|xai|grok,colossus,inference,data
Tesla|TSLA|greenhouse|tesla|optimus,robot,dojo,fsd,autopilot,robotaxi,energy
Apple|AAPL|careers|https://jobs.apple.com/en-us/search?search=machine+learning|siri,intelligence,vision,spatial,health,car,robotics
NVIDIA|NVDA|greenhouse|nvidia|blackwell,rubin,nim,omniverse,cosmos,robotics,ace
Palantir|PLTR|greenhouse|palantir|aip,foundry,defense,agent,warp
CrowdStrike|CRWD|greenhouse|crowdstrike|charlotte,ai,next-gen,xdr
Snowflake|SNOW|greenhouse|snowflake|cortex,arctic,ai,agent,polaris
Coinbase|COIN|greenhouse|coinbase|base,layer2,agent,defi,staking,derivatives
Databricks||greenhouse|databricks|mosaic,model,agent,governance
Scale AI||lever|scaleai|government,defense,donovan,auto
Figma||greenhouse|figma|ai,slides,dev-mode,component
Stripe||greenhouse|stripe|crypto,stablecoin,banking,identity,issuing
Perplexity||lever|perplexity-ai|enterprise,finance,agent,ads
"""
)

# name|ticker|paper search query.
PAPER_QUERIES = pairs(
    """
Google/DeepMind|GOOGL|all:google+AND+all:language+model+OR+all:deepmind
Meta FAIR|META|all:meta+AND+all:fair+AND+all:language+model
OpenAI||all:openai+AND+all:language+model+OR+all:reasoning
Anthropic||all:anthropic+AND+all:language+model+OR+all:safety
Microsoft Research|MSFT|all:microsoft+research+AND+all:language+model
Apple ML|AAPL|all:apple+AND+all:machine+learning+AND+all:on-device
NVIDIA Research|NVDA|all:nvidia+AND+all:inference+OR+all:training+efficiency
Tesla AI|TSLA|all:tesla+AND+all:autonomous+OR+all:robot+OR+all:self-driving
AMD Research|AMD|all:amd+AND+all:gpu+AND+all:machine+learning
Salesforce Research|CRM|all:salesforce+AND+all:language+model+OR+all:agent
"""
)

# name|code-hosting organisation.
REPO_ORGS = pairs(
    """
Anthropic|anthropics
Anthropic MCP|modelcontextprotocol
OpenAI|openai
Google DeepMind|google-deepmind
Google Research|google-research
Google|google
Meta FAIR|facebookresearch
Meta|facebook
Microsoft|microsoft
xAI|xai-org
Mistral|mistralai
Stability AI|Stability-AI
Hugging Face|huggingface
DeepSeek|deepseek-ai
Cohere|cohere-ai
Runway|runwayml
ElevenLabs|elevenlabs
Cognition (Devin)|cognition-labs
Character.ai|character-ai
Cursor|getcursor
Vercel|vercel
Supabase|supabase
Stripe|stripe
Linear|linearapp
Railway|railwayapp
Cloudflare|cloudflare
Docker|docker
Sourcegraph|sourcegraph
Replit|replit
Roblox|Roblox
Discord|discord
Bluesky|bluesky-social
Signal|signalapp
Telegram|nicegram
Databricks|databricks
Snowflake|snowflakedb
Elastic|elastic
CrowdStrike|CrowdStrike
HashiCorp|hashicorp
Apple|apple
Tesla|teslamotors
"""
)

# name|model-hub organisation.
MODEL_ORGS = pairs(
    """
Anthropic (HF)|Anthropic
OpenAI (HF)|openai
Google (HF)|google
Meta (HF)|meta-llama
Meta FAIR (HF)|facebook
Microsoft (HF)|microsoft
Mistral (HF)|mistralai
xAI (HF)|xai-org
Stability AI (HF)|stabilityai
NVIDIA (HF)|nvidia
Apple (HF)|apple
Salesforce (HF)|Salesforce
Databricks (HF)|databricks
Cohere (HF)|CohereForAI
DeepSeek (HF)|deepseek-ai
Qwen (HF)|Qwen
ElevenLabs (HF)|elevenlabs
Runway (HF)|runwayml
Adobe (HF)|Adobe
Samsung (HF)|Samsung
Intel (HF)|Intel
AMD (HF)|amd
Snowflake (HF)|Snowflake
Reka (HF)|RekaAI
AI21 (HF)|AI21Labs
Together (HF)|togethercomputer
Nous Research (HF)|NousResearch
01.AI (HF)|01-ai
Black Forest Labs (HF)|black-forest-labs
"""
)

# name|page url|priority keywords.
SCRIPT_TARGETS = pairs(
    """
ChatGPT|https://chatgpt.com|gpt-5,o3,reasoning,agent,canvas,operator,codex
Claude|https://claude.ai|opus,haiku,sonnet,artifact,project,memory,computer_use
Gemini|https://gemini.google.com|ultra,flash,nano,gems,deep-research
Perplexity|https://www.perplexity.ai|sonar,pro,enterprise,finance,agent
Grok|https://grok.com|grok-3,colossus,aurora,build
"""
)

# name|documentation urls|keywords.
DOC_TARGETS = pairs(
    """
OpenAI API Docs|https://platform.openai.com/docs/models,https://platform.openai.com/docs/changelog|gpt,model,new,beta,deprecated,preview
Anthropic API Docs|https://docs.anthropic.com/en/docs/about-claude/models|claude,model,new,opus,sonnet,haiku
Google AI Docs|https://ai.google.dev/gemini-api/docs/models|gemini,model,new,flash,pro,ultra
"""
)

# name|sitemap url|interesting url patterns.
SITEMAP_TARGETS = pairs(
    """
OpenAI|https://openai.com/sitemap.xml|/blog/,/product/,/research/,/index/
Anthropic|https://www.anthropic.com/sitemap.xml|/news/,/research/,/claude
Google DeepMind|https://deepmind.google/sitemap.xml|/discover/,/research/,/technologies/
"""
)

# name|repository|watched parts|keywords.
REPO_TARGETS = pairs(
    """
LLaMA (Meta)|meta-llama/llama|releases|llama
Ollama|ollama/ollama|releases|
LangChain|langchain-ai/langchain|releases|agent,tool
"""
)

# name|store id.
IOS_APPS = pairs(
    """
ChatGPT iOS|6448311069
Claude iOS|6473753684
Gemini iOS|6477489129
Perplexity iOS|1668000334
Grok iOS|6670324846
Copilot iOS|6738605245
"""
)

# name|package.
ANDROID_APPS = pairs(
    """
ChatGPT Android|com.openai.chatgpt
Claude Android|com.anthropic.claude
Gemini Android|com.google.android.apps.bard
Perplexity Android|ai.perplexity.app.android
"""
)

# name|domain|extra subdomain words.
DOMAIN_TARGETS = pairs(
    """
OpenAI|openai.com|codex,sora,operator,agent,swarm,o3
Anthropic|anthropic.com|claude,opus,workbench,tools
Google AI|google.com|gemini,notebooklm,aistudio,stitch
"""
)

# name|page url.
PAGE_TARGETS = pairs(
    """
OpenAI Changelog|https://help.openai.com/en/articles/6825453-chatgpt-release-notes
Anthropic News|https://www.anthropic.com/news
Google AI Blog|https://blog.google/technology/ai/
Chrome Status Features|https://chromestatus.com/features
"""
)

# Model registries with ticker and address, and the pages that show a grantee's or a filer's filings.
REGISTRIES = (
    ("OpenAI", "OpenAI", "https://api.openai.com/v1/models"),
    ("Anthropic", "Anthropic", "https://api.anthropic.com/v1/models"),
    ("Google AI (Gemini)", "GOOGL", "https://generativelanguage.googleapis.com/v1beta/models"),
    ("Groq", "Groq", "https://api.groq.com/openai/v1/models"),
    ("Together AI", "Together", "https://api.together.xyz/v1/models"),
)
GRANTEE_URL = (
    "https://apps.fcc.gov/oetcf/eas/reports/GenericSearch.cfm?RequestTimeout=500&calession=&id_grantee={code}&id_product_code=&applicant_name="
    "&grant_date_from=&grant_date_to=&comments=&application_purpose=&grant_code=&id_fcc=&facility_id=&fcc_search_type=&show_records=10"
)
FILER_URL = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK={cik}&type=8-K&dateb=&owner=include&count=10"

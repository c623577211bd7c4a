"""Word lists, patterns and constants that decide what counts as a signal.

Everything in this module is a fixed value: results depend on it literally.
Patterns are written in plain regex notation (``\\w \\d \\s \\b`` mean the
Unicode classes) and expanded by :mod:`snapdrift.functions.patterns`.
"""

from __future__ import annotations

# Script urls containing one of these words are trackers.
TRACKER_WORDS = """
analytics gtag gtm pixel tracking hotjar sentry datadog segment mixpanel
amplitude intercom hubspot marketo pardot drift google-analytics
googletagmanager facebook twitter linkedin pinterest snap clarity fullstory
logrocket heap recaptcha hcaptcha turnstile
""".split()

# Literals that are language, markup or protocol tokens.
SCRIPT_NOISE_TOKENS = """
undefined null true false object function string number boolean symbol bigint
default export import return module require prototype constructor length value
index type name data error message status result callback promise resolve
reject then catch async await class extends super this new get set delete
typeof instanceof void yield static const var let break continue switch case
throw try finally debugger with label enum implements interface package private
protected public
div span input button select option form img href src alt title placeholder
aria-label role hidden disabled checked selected required readonly click change
submit focus blur keydown keyup mousedown mouseup mouseover mouseout touchstart
scroll resize load unload beforeunload block inline flex grid none auto inherit
relative absolute fixed sticky center left right bold italic normal pointer
default text
GET POST PUT DELETE PATCH HEAD OPTIONS Content-Type Authorization Accept
application/json text/html text/plain multipart/form-data
""".split()

# Literals matching one of these are code or data.
SCRIPT_NOISE_PATTERNS = r"""
^[\da-f]{6,}$
^#[\da-fA-F]{3,8}$
^[\d.]+px$
^[\d.]+rem$
^[\d.]+em$
^[\d.]+%$
^rgba?\(
^hsla?\(
^data:
^https?://
^/[a-z]
^\.
^[A-Za-z0-9+/]{40,}
^\d+(\.\d+)*$
^[a-z]{1,2}$
^[A-Z]{1,2}$
^_
^\$
^@@
^\w+\.\w+\.\w+\.\w+
^[a-z]+[A-Z][a-z]+[A-Z][a-zA-Z]*$
^\{[\{\[]
^<[a-zA-Z]
^svg\s
^M[\d\s,.-]+$
^[a-f0-9]{32,}$
^[A-Za-z0-9_-]+={1,2}$
^\w+:\w+:\w+
^\d{10,}$
^[,;]\w+:
^\w+[,;]$
^[,.:;!?]
""".split("\n")[1:-1]

# Phrases that point to an unreleased feature.
SCRIPT_INTEREST_PATTERNS = r"""
coming soon
not yet available
not available yet
under development
in development
will be available
available soon
new feature
try the new
introducing
launching soon
early access
sneak peek
behind the scenes
internal[_ ]only
dogfood
canary
experimental
prototype
unreleased
\bbeta\b
\bpreview\b
feature[_ ]flag
roll[_ ]?out
enabled[_ ]for
disabled[_ ]for
% of users
A/B test
experiment[_ ]?id
""".split("\n")[1:-1]

# Fixed value: characters of which a literal may hold at most three.
CODE_CHARS = "{}[]();<>=!&|^~@#$%"

# Documentation lines that carry a product signal.
DOC_SIGNAL_PATTERNS = r"""
\bnew\b
\blaunch
\breleased?\b
\bannounce
\bintroduc
\bnow available\b
\bnow support
\bcoming soon\b
\brolling out\b
\bgenerally available\b
\bGA\b
\bbeta\b
\bpreview\b
\bexperimental\b
\bearly access\b
\bRBAC\b
\baccess control\b
\bpermission
\brole-based\b
\bSSO\b
\bSAML\b
\bOAuth\b
\bMFA\b
\b2FA\b
\bnew API\b
\bendpoint
\bwebhook
\bSDK\b
\bintegration\b
\bconnector\b
\bplugin\b
\bextension\b
\bmigrat
\bdeprecated?\b
\bsunset
\bend.of.life\b
\bbreaking change\b
\bbackward
\bpric
\bplan\b
\btier\b
\bfree\b
\benterprise\b
\bpro\b
\bpremium\b
\bsubscription\b
\bmodel\b
\bagent\b
\bLLM\b
\bGPT\b
\bgemini\b
\bclaude\b
\bcopilot\b
\bAI\b
\blimit
\bquota\b
\brate.limit\b
\bthrottle\b
\bcapacity\b
\bscaling\b
\bregion\b
\bcompliance\b
\bGDPR\b
\bSOC\b
\bHIPAA\b
\bencrypt
\bprivacy\b
""".split("\n")[1:-1]

# Documentation lines that never matter.
DOC_NOISE_PATTERNS = r"""
^\d{4}[-/]\d{2}[-/]\d{2}$
^(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d
^updated?\s*(on|:)?\s*\d
^last\s*(modified|updated|edited)
^copyright\s
^©\s
^\s*\d+\s*$
^(home|about|contact|blog|docs|faq|help|terms|privacy)\s*$
""".split("\n")[1:-1]

# Resource names that never hold product copy.
RESOURCE_NAME_PREFIXES = """
content_desc accessibility abc_ mtrl_ material_ design_ nav_ common_ error_
debug_ test_ mock_ legacy_ deprecated_ font_ color_ dimen_ style_ attr_ layout_
menu_ drawable_
""".split()

# Resource values that point to a coming feature.
RESOURCE_INTEREST_PATTERNS = """
coming soon
not yet available
beta
preview
experimental
early access
rolling out
limited availability
try the new
upgrade to
upgrade your
new feature
behind the scenes
A/B test
feature flag
gradual rollout
% of users
canary
dogfood
internal only
staff only
employee preview
connector
integration
plugin
extension
agent
introducing
now available
just launched
""".split("\n")[1:-1]

# Resource values that are data or stock labels.
RESOURCE_NOISE_PATTERNS = r"""
^https?://
^[0-9.]+$
^#[0-9a-fA-F]+$
^[{}\[\]<>]
^\w+\.\w+\.\w+
^@\w+/
^res/
^android\.
^[a-f0-9]{16,}$
^\s*$
^\.+$
^-+$
^(true|false|null|none|undefined|ok|cancel|yes|no|done|close|back|next|save|delete|edit|share|copy|paste)$
""".split("\n")[1:-1]

# Title-case labels every app has.
STOCK_LABELS = """
Got It
Sign In
Sign Up
Log In
Log Out
Next Step
Go Back
Learn More
Read More
Try Again
View All
See All
Show More
Not Now
No Thanks
""".split("\n")[1:-1]

# Fixed value: shape of a title-case feature name.
TITLE_CASE_PATTERN = r"^[A-Z][a-z]+(?: [A-Z][a-z]+)+$"

# Subdomain words worth probing.
SUBDOMAIN_WORDS = """
api beta alpha dev staging preview canary next lab labs experiment test new v2
v3 studio pro plus premium enterprise dashboard console app mobile agent ai ml
chat assistant docs developer developers build create design analytics insights
reports search marketplace
""".split()

# Certificate names containing one of these are infrastructure.
CERT_NOISE_WORDS = """
cdn static assets asset media. img. images. photos photo- video. fonts css.
resources
lb- lb. wl- haproxy nginx proxy gateway. gateway- edge- node- replica shard
cluster
mail smtp imap pop3 mx. email postfix dkim spf. dmarc bounce
monitor metrics logging. grafana prometheus sentry health. ping. -ping.
heartbeat nagios
ci. ci- cd. cd- build. build- deploy staging stg. stg- qa. qa- uat. uat- test.
test- testing sandbox dev. dev- dev1 dev2 dev3 dev4 dev5 preprod pre-prod
canary. internal. corp.
ns1 ns2 ns3 dns. vpn. vpn- bastion jump
sso. auth. oauth. login. signin. idp. saml
track pixel. /pixel beacon analytics telemetry collect.
db. db- redis. mongo. mysql. postgres. elastic. kafka. rabbit. memcache s3.
www. api. api- admin. console. dashboard. docs. help. support. billing invoic
careers jobs. ir. investor status.
dropoff fulfillment handoff delivery- dasher driver. courier merchant-
autopush gcr. ecr. registry. cache. varnish fastly prism
""".split()

# Certificate names matching one of these are generated.
CERT_NOISE_PATTERNS = r"""
^[0-9]
^ip-\d+
^i-[a-f0-9]+
^ec2-
-\d{8,}
-[a-f0-9]{8,}$
^[a-z]-[a-z0-9]{4,}$
^[a-z]{2,3}[0-9]{2,}$
^[a-z]{2,6}[0-9]{2,}$
""".split("\n")[1:-1]

# Asset urls containing one of these are trackers.
ASSET_NOISE_WORDS = """
/pixel/ /pixel? beacon analytics gtag /collect tracker 1x1 spacer
""".split()

# Asset paths matching one of these are content hashes.
ASSET_LONG_HASH = r"[A-Za-z0-9_-]{40,}"
ASSET_HASH_SEGMENT = r"^[A-Za-z0-9_-]{20,}$"
ASSET_HASH_FILE = r"/[a-f0-9]{8,}\.(png|jpg|jpeg|gif|webp|svg|woff|woff2|ttf|css|js)$"

# Words that make a text look like a job title.
ROLE_WORDS = """
engineer
manager
director
lead
scientist
researcher
designer
analyst
architect
head of
vp of
developer
specialist
strategist
""".split("\n")[1:-1]

# Service prefixes asked for TXT records.
DNS_SERVICE_PREFIXES = """
_dmarc _mta-sts _domainkey selector1._domainkey selector2._domainkey
""".split()

# Trademark listing patterns, main and alternate.
TRADEMARK_SERIAL_MARK = r"(\d{8})\s*[-]\s*([A-Z][A-Z0-9\s\.\-]+)"
TRADEMARK_WORD_MARK = r"(?:Word Mark|Mark)[\s:]+([A-Z][A-Z0-9\s]+)"

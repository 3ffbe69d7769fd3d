"""Sites by kind, which the classes of functions.urls are defined by."""

WIKIMEDIA = "wikipedia.org wikimedia.org wikidata.org wiktionary.org".split()

ACADEMIC_SITES = """
nih.gov ncbi.nlm.nih.gov arxiv.org biorxiv.org medrxiv.org sciencedirect.com springer.com springeropen.com nature.com wiley.com
onlinelibrary.wiley.com jstor.org researchgate.net semanticscholar.org plos.org frontiersin.org mdpi.com tandfonline.com sagepub.com
cell.com pnas.org bmj.com thelancet.com acs.org aps.org ieee.org acm.org elsevier.com academic.oup.com oup.com cambridge.org
journals.plos.org europepmc.org ssrn.com researchsquare.com ebsco.com
""".split()
ACADEMIC_HOSTS = "scholar.google.com eric.ed.gov".split()

NEWS_SITES = """
nytimes.com washingtonpost.com wsj.com reuters.com apnews.com bbc.com bbc.co.uk cnn.com cnbc.com nbcnews.com abcnews.go.com
cbsnews.com foxnews.com theguardian.com ft.com bloomberg.com economist.com time.com newsweek.com usatoday.com latimes.com
politico.com thehill.com axios.com vox.com huffpost.com buzzfeednews.com npr.org pbs.org aljazeera.com france24.com dw.com espn.com
theconversation.com pcmag.com tomshardware.com space.com techcrunch.com theverge.com wired.com arstechnica.com zdnet.com cnet.com
engadget.com thenextweb.com venturebeat.com mashable.com gizmodo.com scientificamerican.com livescience.com sciencedaily.com
newscientist.com sciencenews.org forbes.com businessinsider.com fortune.com inc.com fastcompany.com hbr.org irishtimes.com rte.ie
independent.ie thejournal.ie telegraph.co.uk independent.co.uk mirror.co.uk dailymail.co.uk sky.com
""".split()

REFERENCE_SITES = """
britannica.com investopedia.com merriam-webster.com dictionary.com webmd.com mayoclinic.org healthline.com statista.com
khanacademy.org howstuffworks.com clevelandclinic.org medicalnewstoday.com vocabulary.com collinsdictionary.com grokipedia.com
worldhistory.org archive.org gutenberg.org thesaurus.com
""".split()
REFERENCE_HOSTS = "dictionary.cambridge.org baike.baidu.com".split()

COMMUNITY_SITES = """
reddit.com quora.com stackoverflow.com stackexchange.com medium.com substack.com github.com gitlab.com linkedin.com twitter.com
x.com youtube.com facebook.com tiktok.com fandom.com wordpress.com scribd.com blogspot.com tumblr.com pinterest.com tripadvisor.com
""".split()
COMMUNITY_HOSTS = ["zhidao.baidu.com"]

PUBLIC_SITES = "canada.ca europa.eu admin.ch nhs.uk un.org oecd.org iea.org iaea.org imf.org worldbank.org wto.org unesco.org unicef.org".split()

JOURNAL_PUBLISHERS = """
nature.com springer.com wiley.com elsevier.com sciencedirect.com tandfonline.com sagepub.com mdpi.com frontiersin.org cell.com
thelancet.com bmj.com plos.org pnas.org oup.com academic.oup.com annualreviews.org cambridge.org degruyter.com acs.org rsc.org
iop.org aip.org nejm.org jama.com jamanetwork.com karger.com hindawi.com iospress.com liebertpub.com futuremed.com thieme.com
""".split()
PREPRINT_SERVERS = """
arxiv.org biorxiv.org medrxiv.org ssrn.com preprints.org osf.io zenodo.org figshare.com researchsquare.com techrxiv.org
eartharxiv.org chemrxiv.org engrxiv.org psyarxiv.com
""".split()
RESEARCH_DATABASES = """
pubmed.ncbi.nlm.nih.gov ncbi.nlm.nih.gov scholar.google.com semanticscholar.org jstor.org researchgate.net dimensions.ai
webofscience.com scopus.com crossref.org doaj.org core.ac.uk base-search.net europepmc.org lens.org
""".split()
UNIVERSITY_MARKS = """
.edu .ac.uk .ac.jp .edu.au .edu.sg .ac.in .edu.cn .ac.nz .edu.br .ac.za .edu.mx .ac.kr .edu.tr .edu.pl .uni- .university
""".split()

FORUMS = """
reddit.com quora.com stackoverflow.com stackexchange.com discourse.org producthunt.com slashdot.org hackernews.com
news.ycombinator.com answers.com superuser.com serverfault.com askubuntu.com mathoverflow.net
""".split()
SOCIAL_SITES = """
twitter.com x.com facebook.com instagram.com linkedin.com tiktok.com pinterest.com threads.net mastodon.social bsky.app tumblr.com
snapchat.com
""".split()
VIDEO_SITES = "youtube.com vimeo.com dailymotion.com rumble.com bitchute.com".split()
BLOG_SITES = """
medium.com substack.com wordpress.com blogger.com blogspot.com ghost.org hashnode.dev dev.to mirror.xyz wix.com squarespace.com
weebly.com
""".split()
CODE_SITES = "github.com gitlab.com bitbucket.org codepen.io replit.com codesandbox.io kaggle.com huggingface.co observablehq.com".split()

#: Authority tiers in the order in which they are tried; Gov / Edu also has suffixes, and comes after Academic.
TIERS = {
    "Academic": """
ncbi.nlm.nih.gov arxiv.org doi.org nature.com science.org sciencedirect.com springer.com springeropen.com wiley.com tandfonline.com
jstor.org researchgate.net ssrn.com biorxiv.org medrxiv.org plos.org frontiersin.org mdpi.com ieee.org acm.org semanticscholar.org
cell.com bmj.com thelancet.com nejm.org pnas.org sagepub.com cambridge.org oup.com annualreviews.org aps.org rsc.org iop.org
jamanetwork.com
""".split(),
    "Gov / Edu": "canada.ca gc.ca nhs.uk europa.eu govt.nz gov.au".split(),
    "Encyclopedic": "wikipedia.org wikimedia.org wiktionary.org wikisource.org wikibooks.org britannica.com merriam-webster.com scholarpedia.org".split(),
    "News / media": """
nytimes.com washingtonpost.com wsj.com bbc.co.uk bbc.com reuters.com apnews.com theguardian.com guardian.co.uk cnn.com nbcnews.com
abcnews.go.com cbsnews.com npr.org bloomberg.com forbes.com economist.com ft.com time.com theatlantic.com vox.com axios.com
politico.com aljazeera.com dw.com cnbc.com businessinsider.com usatoday.com latimes.com newyorker.com telegraph.co.uk
scientificamerican.com nationalgeographic.com techcrunch.com theverge.com wired.com arstechnica.com engadget.com
""".split(),
    "Tech / software": """
python.org microsoft.com mozilla.org w3schools.com geeksforgeeks.org freecodecamp.org techradar.com pcmag.com tomshardware.com
cnet.com zdnet.com digitaltrends.com howtogeek.com makeuseof.com kubernetes.io docker.com oracle.com ibm.com redhat.com gsmarena.com
androidauthority.com 9to5mac.com macrumors.com lifewire.com stackoverflow.blog
""".split(),
    "Health / medical": """
clevelandclinic.org webmd.com healthline.com mayoclinic.org medicalnewstoday.com psychologytoday.com verywellhealth.com
verywellmind.com drugs.com everydayhealth.com medicinenet.com health.com goodrx.com kidshealth.org hopkinsmedicine.org patient.info
mommed.com medanta.org healthgrades.com
""".split(),
    "Reference / education": """
dictionary.com thesaurus.com study.com cliffsnotes.com sparknotes.com coursehero.com khanacademy.org investopedia.com archive.org
gutenberg.org biography.com thoughtco.com encyclopedia.com collinsdictionary.com vocabulary.com byjus.com toppr.com education.com
""".split(),
    "Org / NGO / think-tank": """
un.org oecd.org imf.org wto.org weforum.org cato.org rand.org pewresearch.org oceanconservancy.org planetary.org
learningpolicyinstitute.org redcross.org worldbank.org amnesty.org wwf.org who.int
""".split(),
    "UGC / social": """
reddit.com youtube.com youtu.be quora.com twitter.com x.com facebook.com instagram.com tiktok.com stackexchange.com
stackoverflow.com superuser.com serverfault.com askubuntu.com medium.com substack.com linkedin.com pinterest.com tumblr.com
github.com github.io discord.com fandom.com wikihow.com
""".split(),
}

#: Public suffixes of two labels that are known here; every last label is one too.
TWO_LABEL_SUFFIXES = [f"{second}.{country}" for country in "uk jp au nz za in kr br mx tr pl cn sg ie il id th".split() for second in "ac co com edu gov go gob gouv gc mil ne net nhs nsw or org".split()] + "gc.ca gouv.fr govt.nz".split()

#: Public suffix rules in their published form, for hosts under which others register: every plain two-label suffix above, and
#: these fixed values. `*` stands for any one label, `!` for an exception to such a rule. Rules of a full list can be given instead.
SUFFIX_RULES = [
    *"com org net edu gov mil int info biz io co us uk ac jp ck mm cn ca de fr es it nl eu au nz in br mx za ru ch se no pl tr kr hk tw sg ie be at dk fi pt gr cz il id th".split(),
    *TWO_LABEL_SUFFIXES,
    *"uk.com us.com gb.com eu.com de.com".split(),
    *"ak.us ca.us ny.us tx.us wa.us k12.ak.us k12.ca.us k12.ny.us".split(),
    *"kyoto.jp ide.kyoto.jp osaka.jp tokyo.jp".split(),
    *"*.ck !www.ck *.mm *.er *.fk *.kh *.np *.pg".split(),
    *"*.kawasaki.jp !city.kawasaki.jp *.kitakyushu.jp !city.kitakyushu.jp *.kobe.jp !city.kobe.jp *.nagoya.jp !city.nagoya.jp *.sapporo.jp !city.sapporo.jp *.sendai.jp !city.sendai.jp *.yokohama.jp !city.yokohama.jp".split(),
]
